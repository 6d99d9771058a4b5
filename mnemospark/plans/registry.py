"""All queries of the engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; sql is its DuckDB twin."""

    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


from mnemospark.plans import time_queries  # noqa: E402, F401  (registers its queries)
from mnemospark.plans import eval_queries  # noqa: E402, F401
from mnemospark.plans import graph_queries  # noqa: E402, F401
from mnemospark.plans import record_queries  # noqa: E402, F401
from mnemospark.plans import report_queries  # noqa: E402, F401
from mnemospark.plans import source_queries  # noqa: E402, F401
from mnemospark.plans import text_queries  # noqa: E402, F401
from mnemospark.plans import training_queries  # noqa: E402, F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic retrieval: seeds, ranks over the fact graph, the best triples of each question."""
    return _QUERIES["semantic_retrieve"](spark, sf_dir)
