"""Training-data operators: secrets, quality, WARC, decontamination, PII, BPE, language, dedup, toxicity, SimHash."""
