"""Training-data operators: scoring, deduplication, mixing, packing, sharding."""
