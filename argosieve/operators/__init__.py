"""Relational operators: extraction, classification, lookups, checks."""
