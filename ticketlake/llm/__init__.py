"""Operators of a training-data pipeline: packing, deduplication, tokenising, quality, extraction, archives, scoring."""
