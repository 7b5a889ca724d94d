"""Larkspur: a T-SQL dialect and data-processing engine on top of Spark SQL."""
