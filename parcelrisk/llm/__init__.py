"""Operators that prepare text and vector corpora for training; nothing outside this package imports it."""
