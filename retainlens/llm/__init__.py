"""Training-data pipeline operators (toxicity, dedup, WARC, PII, tokens, packing, quality, search)."""
