"""Road-network and trajectory analytics on Spark DataFrames."""
