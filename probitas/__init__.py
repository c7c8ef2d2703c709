"""Data-quality metrics, checks and contracts on Spark DataFrames."""
