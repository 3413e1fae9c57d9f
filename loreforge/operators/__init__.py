"""Operators: functions from DataFrames and parameters to DataFrames.  None of them reads a clock or draws at random."""
