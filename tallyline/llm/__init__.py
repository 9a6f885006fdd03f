"""Operators of a training-data pipeline: scoring, search, near-duplicates, filters, tokenisation."""
