"""Evidence and retrieval analytics on Spark: every operator is a function from DataFrames to DataFrames."""
