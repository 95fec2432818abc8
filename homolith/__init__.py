"""Topological comparison of many samples on Spark."""
