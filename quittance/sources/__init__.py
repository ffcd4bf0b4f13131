"""Readers, writers and generators of ledgers, statements and results."""
