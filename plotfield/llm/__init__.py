"""Operators for preparing text corpora: extraction, quality, duplicates, tokens."""
