"""Land-suitability analytics on Spark DataFrames."""
