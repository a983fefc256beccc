"""Document-revision comparison and corpus preparation on Spark DataFrames."""
