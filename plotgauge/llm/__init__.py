"""Operators for preparing language-model training data.

Nothing outside this folder imports it, so it can be removed as a whole.
Every operator takes and returns DataFrames and leaves partitioning to Spark.
"""
