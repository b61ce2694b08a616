"""Operators for text corpora: overlap, sampling, deduplication, tokens, packing, shared spans."""
