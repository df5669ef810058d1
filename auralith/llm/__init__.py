"""Operators for preparing training text: deduplication, scoring, filtering, tokenising, packing, extraction."""
