"""Operators that prepare training text: near-duplicates, tokens, filters, packing and sharding."""
