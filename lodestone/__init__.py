"""Lodestone: retrieval analytics over Spark DataFrames."""
