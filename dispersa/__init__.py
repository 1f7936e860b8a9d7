"""Count-dispersion analytics on Spark DataFrames."""
