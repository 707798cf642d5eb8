"""Catalog operators: functions from DataFrames to DataFrames."""
