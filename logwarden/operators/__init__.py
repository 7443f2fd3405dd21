"""DataFrame operators: each maps DataFrames to a DataFrame."""
