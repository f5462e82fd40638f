"""Operators of a training-data pipeline: deduplication, filtering, mixing, sharding, packing, token files."""
