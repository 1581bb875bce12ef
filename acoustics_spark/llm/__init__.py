"""Training-data operators: deduplication, language, tokens, quality, extraction, privacy, packing, sharding."""
