"""Training-data operators: each takes and returns Spark DataFrames."""
