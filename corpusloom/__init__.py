"""Spark-first engine for building a research corpus from raw posts."""
