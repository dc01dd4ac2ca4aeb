"""Retrieval-oriented document analytics on Spark DataFrames."""
