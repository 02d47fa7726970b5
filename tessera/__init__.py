"""Coverage analytics on Spark DataFrames."""
