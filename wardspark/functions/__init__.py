"""Column functions: text, regex, entropy, payloads, versions and identifiers."""
