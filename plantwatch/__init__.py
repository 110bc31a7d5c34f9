"""Condition-monitoring analytics on Spark DataFrames."""
