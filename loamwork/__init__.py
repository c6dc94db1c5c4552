"""Retrieval, de-duplication and knowledge-log analytics on Spark DataFrames."""
