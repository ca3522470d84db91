"""Training-data operators (packing, language ID, toxicity, fingerprints, tokenizing, quality, WARC, PII,
near-dedup, sharding) and their registered queries (``llm.queries``). Nothing outside this folder imports it."""
