"""Retrieval and analytics over time-windowed media, as Spark DataFrames."""
