"""Operators for training-data pipelines: deduplication, packing, scoring, mixing, scanning and search."""
