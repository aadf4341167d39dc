"""Operators of the catalog library."""
