"""News-intelligence analytics on Spark DataFrames."""
