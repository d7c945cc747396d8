"""Evidence and data-integrity analytics on Spark DataFrames."""
