"""Training-data operators: text scoring, deduplication, tokenisation and packing."""
