"""Operators and pipeline stages for preparing training data.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames, reads only the columns its docstring names (extra columns are ignored)
and returns a DataFrame.
"""
