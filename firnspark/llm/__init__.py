"""Operators for building training data: deduplication, tokenizing, scoring, packing and search."""
