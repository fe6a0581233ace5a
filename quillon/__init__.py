"""Security analytics for source code and text, as Spark DataFrames."""
