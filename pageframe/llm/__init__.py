"""Operators that prepare recognised pages and documents as training text.

Nothing outside this subpackage imports it.
"""
