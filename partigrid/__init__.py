"""Graph-partition analytics on Spark DataFrames."""
