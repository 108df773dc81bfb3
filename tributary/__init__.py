"""tributary: rank fusion and result-list processing on Spark DataFrames."""
