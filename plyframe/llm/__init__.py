"""Operators for building training corpora of language models.

Nothing else in the library imports this subpackage.
"""
