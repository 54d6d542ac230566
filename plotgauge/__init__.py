"""Spark jobs for scoring and analysing machine-written chart code, on DataFrames only."""
