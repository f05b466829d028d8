"""Operators for large training-data pipelines: search, scoring, filtering, deduplication, mixing and archives."""
