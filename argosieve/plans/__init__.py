"""Indicator sets and the scans that use them."""
