"""Bitemporal time-series panels on Spark DataFrames."""
