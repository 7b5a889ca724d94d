"""Scalar and aggregate functions of the dialect, as Spark SQL."""
