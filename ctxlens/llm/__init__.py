"""Operators of a training-data pipeline: search, deduplication, filters, extraction, packing."""
