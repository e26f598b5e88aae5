"""Analytics over declared tabular data, built on Spark DataFrames."""
