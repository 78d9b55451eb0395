"""Training-data operators: search, deduplication, tokens, packing and quality."""
