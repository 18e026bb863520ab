"""Operators that prepare text corpora for model training.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is present.
"""
