"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
column names and returns a DataFrame; ``queries`` registers the contract queries.
"""
