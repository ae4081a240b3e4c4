"""Shoreline: coastal water-level and terrain analytics on Spark DataFrames."""
