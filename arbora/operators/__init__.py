"""Operators on typed graphs held as DataFrames."""
