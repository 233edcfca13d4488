"""Operators for building training data out of text, pages and conversations."""
