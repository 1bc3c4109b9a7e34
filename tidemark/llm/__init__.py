"""Training-data operators: extraction, filtering, deduplication, mixing and packing of text corpora."""
