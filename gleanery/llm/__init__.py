"""Operators for preparing language-model training data.

Every operator takes DataFrames and returns DataFrames. A null text counts as an empty
one, extra columns of a table are never read, and an empty table gives an empty result.
"""
