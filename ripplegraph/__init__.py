"""Change-reach analytics on Spark DataFrames."""
