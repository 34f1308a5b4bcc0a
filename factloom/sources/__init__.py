"""Attribute catalogs over tables, and the datom log."""
