"""Chat-transcript analytics and migration on Spark DataFrames."""

__version__ = "0.1.0"
