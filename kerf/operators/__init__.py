"""Operators: functions from DataFrames to DataFrames, or to columns. All keep project_id in their keys."""
