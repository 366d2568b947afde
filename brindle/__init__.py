"""Corpus preparation and retrieval on Spark DataFrames."""
