"""Operators of a training-data pipeline: near-duplicates, tokens, archives, quality, packing."""
