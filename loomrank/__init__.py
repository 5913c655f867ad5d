"""Ranked retrieval over Spark DataFrames: index build, impact tables, tiered BM25."""
