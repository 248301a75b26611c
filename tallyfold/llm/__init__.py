"""Training-data operators: tokenizing, deduplication, scoring, search, packing."""
