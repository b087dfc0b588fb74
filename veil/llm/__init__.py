"""Operators for preparing training text: deduplication, filtering, tokenizing, mixing, search.

Nothing else in the library imports this package. Each module states its method, its bounds and
what it does with nulls, empty texts, ties and empty tables.
"""
