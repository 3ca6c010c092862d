"""Registry of named queries over the benchmark tables, each with an optional DuckDB twin.

A query is ``fn(spark, sf_dir) -> DataFrame``. Its SQL twin (when the semantics are
expressible in plain SQL) reads the same tables as views and must return the same
columns; doubles are rounded to 6 places on both sides so float summation order cannot
change the comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}
PLACES = 6


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn`` as query ``name`` (with its SQL twin, if any)."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn

    return wrap


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Round every top-level DOUBLE/FLOAT column (comparison-stable output)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def load_all() -> None:
    """Import every module that registers queries."""
    from vigil.plans import (  # noqa: F401
        drift_queries,
        eval_queries,
        lineage_queries,
        sample_queries,
        source_queries,
        stream_queries,
        text_queries,
        model_queries,
    )
