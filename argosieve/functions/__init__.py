"""Expressions and functions over columns."""
