"""Spark-first analytics over coding-agent usage logs and model price history."""
