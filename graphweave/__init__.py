"""Graph analytics on Spark DataFrames."""
