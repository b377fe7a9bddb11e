"""Operators: functions from DataFrames to DataFrames, lazy and without state."""
