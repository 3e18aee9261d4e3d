"""Operators for large text corpora (training-data preparation).

Nothing else in the package imports this subpackage. Every operator is a
function over DataFrames; `queries.py` holds the thin registered queries.
"""
