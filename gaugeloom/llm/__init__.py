"""Operators on texts for training data: answer pairs, terms, phrases, leaks, mixtures, encodings."""
