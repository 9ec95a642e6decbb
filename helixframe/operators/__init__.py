"""Operators: functions from DataFrames to DataFrames; they never collect data."""
