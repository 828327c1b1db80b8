"""Operators for training-data pipelines: cleaning, deduplication, tokens, search, archives, packing."""
