"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each operator lives in a
module of its own and takes and returns DataFrames; ``queries`` holds the thin
queries built on them and their SQL.
"""
