"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Every operator takes DataFrames and column
names, reads only the columns it is told to read, and returns a DataFrame of its own columns; the
registered queries in ``queries`` derive their digest columns from these.
"""
