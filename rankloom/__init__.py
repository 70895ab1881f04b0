"""Batch retrieval, fusion, evaluation and corpus operators on Spark DataFrames."""
