"""DataFrame operators: every one is a pure function from DataFrames to a DataFrame."""
