"""Autoregressive time-series analytics on Spark DataFrames."""
