"""Tidemark: point-in-time document retrieval and analytics on PySpark DataFrames."""
