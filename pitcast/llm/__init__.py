"""Operators that prepare training text: cleaning, deduplication, scoring, tokenizing and packing."""
