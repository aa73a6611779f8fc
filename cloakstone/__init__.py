"""Sensitive-data detection and transformation on Spark DataFrames."""

__version__ = "0.2.0"
