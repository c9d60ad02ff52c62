"""Corpus and vocabulary analytics on Spark: DataFrames in, DataFrames out."""
