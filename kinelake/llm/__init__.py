"""Operators for training-data pipelines: search, mixing, archives, deduplication, scans, scoring and encoding."""
