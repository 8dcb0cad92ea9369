"""Competitive-price analytics on Spark."""
