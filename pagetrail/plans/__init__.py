"""Queries over the given tables, one or more for each operator."""
