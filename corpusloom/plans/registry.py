"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "sim_near_pairs"


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def load() -> None:
    """Fills the registry from the query modules."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"corpusloom.plans.{name}")


MODULES = ("q_text", "q_corpus", "q_eval", "q_models", "q_lineage")
