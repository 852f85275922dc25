"""Operators for text and training data of language models.

Nothing outside this package imports it.
"""
