"""Training-data operators: scoring, cleaning, near-duplicates, decontamination, tokens, secrets and page extraction."""
