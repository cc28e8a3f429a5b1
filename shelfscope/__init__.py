"""Competitive-catalog analytics on Spark."""
