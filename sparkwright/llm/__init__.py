"""Training-data operators: deduplication, extraction, packing, media, sharding, mixing, toxicity, PII."""
