"""Operators for text corpora: personal data, toxicity, decontamination, secrets, similarity, tokens, mixing, quality."""
