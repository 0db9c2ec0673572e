"""Quirework: citation-first retrieval, gating, evaluation and study analytics on Spark DataFrames."""
