"""Invoice analytics on Spark DataFrames, and operators for training-data corpora."""
