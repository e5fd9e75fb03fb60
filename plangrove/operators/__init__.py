"""Relational, graph and geometric operators on DataFrames."""
