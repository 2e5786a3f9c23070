"""Spark-first analytics for binary prediction markets."""
