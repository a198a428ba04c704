"""Chronological rating analytics on Spark DataFrames."""
