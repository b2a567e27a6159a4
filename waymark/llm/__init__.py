"""Training-data operators: extraction, classification, deduplication, tokenising, packing."""
