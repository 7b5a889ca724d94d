"""Operators that Spark has no word for, on DataFrames."""
