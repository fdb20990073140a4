"""Operators that prepare text for language-model training.

Nothing outside this folder imports it.
"""
