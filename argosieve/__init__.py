"""Indicator matching and enrichment on Spark."""
