"""Operators for preparing training text: filters, tokenisation, deduplication, packing, sharding."""
