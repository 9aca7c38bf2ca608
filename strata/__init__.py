"""Commit-history analytics on Spark."""
