"""Operators for preparing training text: mixing, formatting, filtering, deduplication, scoring and sharding."""
