"""Operators that prepare training data for language models.

Nothing outside this subpackage imports it, and it imports nothing from the
rest of the library.
"""
