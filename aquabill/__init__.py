"""Utility-bill analytics on Spark."""
