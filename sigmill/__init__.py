"""Sampled-signal analytics on Spark DataFrames."""
