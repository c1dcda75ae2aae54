"""Operators for large training-data pipelines (extraction, tokenising, dedup, packing)."""
