"""Databases, tables, keys, and the views that describe them."""
