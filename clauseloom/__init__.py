"""Clause-knowledge analytics on Spark DataFrames."""
