"""Content-addressed object analytics on Spark DataFrames."""
