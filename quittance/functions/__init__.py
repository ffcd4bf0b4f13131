"""Scalar functions: money, reference text, fuzzy text, confidence."""
