"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
column names, and returns a DataFrame with a fixed set of columns; other columns
of the input never clash with them because only the named ones are read.
"""
