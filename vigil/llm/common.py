"""Helpers of the operators: scratch tables, worker state, text and array plumbing."""

from __future__ import annotations

import sys
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import scratch_path

#: ASCII white space, the separators of words in every contract here.
WS = "\\x20\\x09-\\x0D"
WORD_PATTERN = f"[^{WS}]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back: cuts lineage, and
    a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker process, across its tasks.
    It only ever holds caches: losing it changes no result."""
    module = sys.modules.setdefault("_vigil_worker_state", types.ModuleType("_vigil_worker_state"))
    return module.__dict__.setdefault("state", {})


def by_id(name: str = "doc_id"):
    """Ascending id, null ids last: the document order of every operator here."""
    return F.col(name).asc_nulls_last()
