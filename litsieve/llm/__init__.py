"""Training-data operators: exact top-k search, WARC, near-dedup, packing, extraction, LM scoring,
mixing, sharding, language ID and document fingerprints. Nothing else in the library imports this."""
