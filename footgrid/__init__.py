"""Spark-first analytics for street-network safety data."""
