"""Sequence, pair and matrix analytics on Spark DataFrames."""
