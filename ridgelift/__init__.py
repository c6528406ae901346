"""Soaring-weather analytics on Spark: gridded and station data to findings, as DataFrames."""
