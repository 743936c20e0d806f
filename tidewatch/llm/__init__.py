"""Training-data operators: mixing, language, fingerprints, deduplication, extraction, toxicity, privacy, secrets, contamination."""
