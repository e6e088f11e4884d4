"""Operators: each takes DataFrames with explicit order columns and returns DataFrames."""
