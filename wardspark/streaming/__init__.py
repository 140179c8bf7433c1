"""The same scoring and scanning over streams."""
