"""Operators for preparing text corpora: quality, duplicates, packing, search, safety, formatting."""
