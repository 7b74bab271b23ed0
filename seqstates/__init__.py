"""Predictive-state analysis of ordered 0/1 event data on Spark DataFrames."""
