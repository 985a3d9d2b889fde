"""Operators for preparing training data: deduplication, screening, sharding, tokens and media."""
