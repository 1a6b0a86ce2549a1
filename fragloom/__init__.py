"""Spark-first analytics for long-read chromosome-conformation-capture data."""
