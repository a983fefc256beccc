"""Operators for training-data corpora: scoring, deduplication, extraction, mixing, sharding."""
