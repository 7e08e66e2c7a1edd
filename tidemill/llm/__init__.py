"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this package.  Every module holds one
operator that takes and returns DataFrames; ``queries`` applies them to the
``documents`` and ``benchmark`` tables.
"""
