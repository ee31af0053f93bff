"""Public operators. Every function takes DataFrames and returns a DataFrame."""
