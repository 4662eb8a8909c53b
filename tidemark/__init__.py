"""Tidemark: transaction-risk analytics and data preparation on Spark DataFrames."""

__version__ = "0.1.0"
