"""Operators for preparing training text: extraction, scoring, deduplication, mixing, encoding.

Nothing else in the library imports this subpackage.
"""
