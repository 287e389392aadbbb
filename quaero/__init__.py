"""Retrieval, evaluation and evidence analytics on Spark DataFrames."""
