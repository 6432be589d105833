"""Operators for preparing training text: deduplication, search, packing, token files, filtering.

Nothing else in the library imports this subpackage.  Each module holds one
operator; `queries.py` applies them to the given tables.
"""
