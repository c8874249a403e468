"""Training-data operators: near-duplicates, packing, filters, tokens, vector search and joins."""
