"""Operators on training data: copies, near-duplicates, splits, pieces, tokens, mixtures, sentences."""
