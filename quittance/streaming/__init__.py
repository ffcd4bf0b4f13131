"""Reconciliation of payments that keep arriving."""
