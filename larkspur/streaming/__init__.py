"""Statements over streams."""
