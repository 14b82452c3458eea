"""Lineweave: ordered-lines analytics on Spark."""
