"""Whole pipelines, the registered queries and their SQL twins."""
