"""Training-data operators: quality, licences, tokens, mixing, dedup, decontamination, toxicity, language."""
