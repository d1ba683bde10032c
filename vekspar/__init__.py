"""A vector and text retrieval engine on Spark DataFrames."""
