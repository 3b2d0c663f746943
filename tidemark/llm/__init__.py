"""Operators for training-data pipelines: extraction, deduplication, filters, archives, mixing, quality."""
