"""Operators: every function takes DataFrames and returns a DataFrame; plans are tables, applying them is a separate step."""
