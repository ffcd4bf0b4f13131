"""Relational operators of a reconciliation run."""
