"""Training-data operators: deduplication, packing, quality, archives, search, secrets, toxicity, tokens."""
