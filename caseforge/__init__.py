"""Vector, evaluation and text analytics on Spark DataFrames."""
