"""Operators for preparing training text: tokens, shards, search, filters, packing and duplicates."""
