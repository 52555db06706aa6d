"""Training-data operators: scoring, near-duplicates, privacy, packing, search and mixing."""
