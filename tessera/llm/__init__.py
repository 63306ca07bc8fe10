"""Operators for large text corpora: one module per operator, queries and their SQL in ``queries``.

Nothing else in the library imports this subpackage.
"""
