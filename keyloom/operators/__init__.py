"""Operators: functions from DataFrames to DataFrames; nothing is collected unless a docstring says so and why it is bounded."""
