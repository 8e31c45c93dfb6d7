"""A timed-text engine on Spark DataFrames."""
