"""simloom: similarity search and vector analytics on Spark DataFrames."""
