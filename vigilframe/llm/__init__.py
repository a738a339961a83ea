"""Operators for large training-data corpora. Nothing outside this package imports it.

Operators that carry a table's other columns along keep them whatever their names are; only names
that begin with `__vf_` are reserved.
"""
