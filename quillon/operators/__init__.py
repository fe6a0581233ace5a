"""Steps of a scan, each from DataFrames to a DataFrame."""
