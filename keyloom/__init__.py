"""Keyword analytics and content planning on Spark DataFrames."""
