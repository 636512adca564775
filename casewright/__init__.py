"""Spark-first analytics over rule-labelled, structured decisions."""
