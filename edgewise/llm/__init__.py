"""Operators of a training-data pipeline over a ``documents`` table.

Nothing else in the library imports this subpackage. Every operator takes a
DataFrame and column names and returns a DataFrame; ``queries`` holds the thin
registered queries that derive their digest columns from operator outputs.
"""
