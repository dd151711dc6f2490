"""Operators for preparing large text corpora, one module each.

Nothing else in the package imports this subpackage. `catalog` holds its queries and SQL.
"""
