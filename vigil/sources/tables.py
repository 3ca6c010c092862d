"""Reading the benchmark tables and mapping them onto the roles the operators use.

Roles (column names are the operator contract):
  reviews       review_id BIGINT, review STRING, sentiment INT
  new_reviews   review_id BIGINT, ts TIMESTAMP, review STRING, sentiment INT, score DOUBLE
  embeddings    vec_id BIGINT, embedding ARRAY<FLOAT>, grp STRING ('ref' | 'new')
  predictions   id BIGINT, y INT, yhat INT
Every role is a projection of a given table, so column pruning and filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Give the scan at least one partition per core.

    A large table stored as one file with one row group is read by a single task, and
    every narrow operator after it (text cleaning, tokenising, exploding) would run
    there too. Only then is the scan redistributed round-robin; a table that already
    yields enough splits (the normal case for large, multi-file data) is left untouched,
    so no shuffle is added at scale.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled reviews: document text with the `quality` label (inner join on doc_id)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("review_id"),
        F.col("text").alias("review"),
        F.col("quality").cast("int").alias("sentiment"),
    )


def lang_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a learnable label: sentiment = (lang = 'en')."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("review_id"),
        F.col("text").alias("review"),
        (F.col("lang") == "en").cast("int").alias("sentiment"),
    )


def new_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monitoring stream stand-in: events with a time, a class and a score."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("review_id"),
        F.col("ts"),
        F.col("props").alias("review"),
        (F.col("event_type") == "purchase").cast("int").alias("sentiment"),
        (F.col("value") / (F.col("value") + F.lit(50.0))).alias("score"),
    )


def embeddings(spark: SparkSession, sf_dir: str, ref_below: int = 4) -> DataFrame:
    """Embedding rows split into a reference group (label < ref_below) and a new group."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "embedding",
        F.when(F.col("label") < ref_below, F.lit("ref")).otherwise(F.lit("new")).alias("grp"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic predictions: y = quality, yhat = toxic."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.col("quality").cast("int").alias("y"),
        F.col("toxic").cast("int").alias("yhat"),
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary label with a continuous score: y = purchase, p1 = value / (value + 50)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
        (F.col("value") / (F.col("value") + F.lit(50.0))).alias("p1"),
    )
