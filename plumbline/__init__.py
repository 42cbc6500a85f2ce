"""Spark-first analytics over paired retrieval-evaluation data."""
