"""Spark-first analytics over disclosure-style event data."""
