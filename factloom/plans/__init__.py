"""Rewrites of the query AST and its compilation to DataFrames."""
