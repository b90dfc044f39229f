"""Operators for training data: scoring, cleaning, deduplication, tokens and chat text."""
