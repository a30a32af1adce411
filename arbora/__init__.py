"""Arbora: typed-graph pattern matching and text preparation on PySpark DataFrames."""
