"""Reconciliation of two sides of messy tables as lazy DataFrame transformations."""
