"""Shape validation of graph-shaped data on Spark DataFrames."""
