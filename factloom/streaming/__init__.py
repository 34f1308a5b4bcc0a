"""Queries over unbounded tables."""
