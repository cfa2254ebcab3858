"""Readers: landed pages, embedded JSON, text cards, caches and stored tables."""
