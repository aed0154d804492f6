"""Operators for text corpora that feed model training; nothing else in the library imports them."""
