"""Multilingual text analytics, semantic search and always-fresh event tables on Spark DataFrames."""
