"""Training-data operators: sharding, quality rules, PII, mixing, BPE, LM scoring, WARC, secrets, near-duplicates.

Nothing outside this package (but for ``__spark_entry__`` and ``corpus_pipeline``) imports it.
"""
