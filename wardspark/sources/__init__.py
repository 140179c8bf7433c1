"""Readers: artifacts, rule files, baselines and audit trails."""
