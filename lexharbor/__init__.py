"""Corpus analytics as Spark DataFrames."""
