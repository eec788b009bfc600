"""inkspan: document analytics on Spark DataFrames."""
