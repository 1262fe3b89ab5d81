"""Traffic range analytics on Spark DataFrames."""
