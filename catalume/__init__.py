"""Hierarchical catalog analytics on Spark."""
