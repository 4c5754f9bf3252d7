"""Training-data operators: scoring, deduplication, decontamination, filtering, packing."""
