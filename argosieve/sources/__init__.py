"""Readers of feeds, logs and compiled databases."""
