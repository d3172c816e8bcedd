"""Maximal shared segments in panels of ordered sequences, on Spark."""
