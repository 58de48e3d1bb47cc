"""Matching and evaluation of time-series recordings, expressed as Spark DataFrames."""
