"""barloom: causal time-series analytics and data processing on Spark DataFrames."""
