"""Operators: each takes DataFrames and gives a DataFrame, without driver-side loops over rows."""
