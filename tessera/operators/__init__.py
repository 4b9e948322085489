"""Operators: each takes DataFrames and parameters and returns DataFrames; bad rows come back as rows, not exceptions."""
