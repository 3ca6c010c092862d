"""Readers and writers at the edge: CSV in, Parquet as the canonical store, JSON batches,
append-by-name, partitioned snapshots and an order-insensitive dataset fingerprint.

CSV is read with header-driven column names so both column orders of the monitored
system's files are accepted; quoted fields may hold commas, doubled quotes and newlines
(``multiLine``, which is not splittable -- ingest CSV once, then work on Parquet).
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.sources import quarantine

REVIEWS = T.StructType([
    T.StructField("review_id", T.LongType(), True),
    T.StructField("review", T.StringType(), True),
    T.StructField("sentiment", T.IntegerType(), True),
    T.StructField("ts", T.TimestampType(), True),
])

# The CSV header names, JSON batch schema and time format of the monitored system.
CSV_NAMES = {"Review": "review", "Sentiment": "sentiment", "Timestamp": "ts"}
BATCH_SCHEMA = "array<struct<Review:string,Sentiment:int>>"
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def judged_reviews_csv(spark: SparkSession, path: str, id_col: str = "review_id") -> DataFrame:
    """Reviews from CSV (either column order), each row with the reason why it cannot be taken, if any. Without
    an id column the id is a hash of the fields. A missing file and one with a header only have no rows."""
    try:
        names = quarantine.csv_options(spark.read).csv(path).columns
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType([*REVIEWS.fields, *[T.StructField(c, T.StringType()) for c in ("reason", "raw")]]))
    headers = {CSV_NAMES.get(c, c): c for c in names}
    columns = {}
    for f in REVIEWS.fields:
        header = headers.get(f.name, f.name)
        parsed = F.try_to_timestamp(F.col(f"`{header}`"), F.lit(TS_FORMAT)) if f.name == "ts" else None
        columns[f.name] = (header, f.dataType, parsed)
    rows = quarantine.judged_csv(spark, path, columns)
    return rows if id_col in headers else rows.withColumn(id_col, F.xxhash64("raw"))


def read_reviews_csv(spark: SparkSession, path: str, id_col: str = "review_id") -> DataFrame:
    """Reviews from CSV, if every row can be taken: a bad row is an error (see `judged_reviews_csv` and
    `quarantine.divided` for a table of rejects instead)."""
    return quarantine.strict(judged_reviews_csv(spark, path, id_col))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, whitespace kept; an empty text is quoted, a missing one is not."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with an explicit schema (no inference)."""
    return quarantine.csv_options(spark.read).schema(schema).csv(path)


def overwrite_table(df: DataFrame, path: str, sort_by: list[str] | None = None) -> None:
    """Write a complete new version of a table (never the folder being read); with
    ``sort_by`` each output file is sorted (a per-task sort, no global shuffle)."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").parquet(path)


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema``, by name and cast; missing ones are null, others go."""
    return df.select(
        *[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def append_table(df: DataFrame, path: str, schema: T.StructType = REVIEWS) -> None:
    """Append rows by column name; missing columns become nulls."""
    conformed(df, schema).write.mode("append").parquet(path)


def append_by_name(base: DataFrame, new: DataFrame) -> DataFrame:
    """UNION ALL by column name; duplicates kept, missing columns null."""
    return base.unionByName(new, allowMissingColumns=True)


def parse_json_records(df: DataFrame, json_col: str, schema: str = BATCH_SCHEMA,
                       required: tuple[str, ...] = ("Review", "Sentiment"), batch_ts=None) -> DataFrame:
    """Rows from a JSON array of objects (a single object is taken as a one-element
    array); rows missing a required field are dropped; optional batch time stamp."""
    text = F.trim(F.col(json_col))
    as_array = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    parsed = df.withColumn("__items", F.from_json(as_array, schema))
    keep = [c for c in df.columns if c != json_col]
    rows = parsed.select(*keep, F.inline_outer("__items"))
    for r in required:
        rows = rows.filter(F.col(r).isNotNull())
    if batch_ts is not None:
        rows = rows.withColumn("ts", F.lit(batch_ts).cast("timestamp"))
    return rows


def batch_stamp(now: dt.datetime | None = None, tz: str = "Asia/Jakarta") -> str:
    """'yyyy-MM-dd HH:mm:ss' wall-clock time in ``tz`` for a batch (driver-side scalar)."""
    from zoneinfo import ZoneInfo

    now = now or dt.datetime.now(dt.timezone.utc)
    return now.astimezone(ZoneInfo(tz)).strftime("%Y-%m-%d %H:%M:%S")


def write_snapshot(df: DataFrame, root: str, tag: str) -> str:
    """Write ``df`` as partition ``snapshot=<tag>`` below ``root`` (dynamic overwrite of that
    partition only); readers prune to it with a filter on ``snapshot``."""
    (
        df.withColumn("snapshot", F.lit(tag))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot")
        .parquet(root)
    )
    return f"{root}/snapshot={tag}"


def row_digest(cols: list[str]):
    """The first 32 bits of the md5 of a row's columns, as a decimal to be summed."""
    row = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols])
    return F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("decimal(20,0)")


def fingerprint(df: DataFrame, cols: list[str], text_col: str | None = None) -> DataFrame:
    """Order-insensitive content digest, one row: n_rows, total_chars, digest_sum, digest_xor.

    digest_sum adds the first 32 bits of each row's md5 (duplicates count twice);
    digest_xor folds the 64-bit xxhash of each row (a cheap second check)."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.length(F.col(text_col or cols[0]))).cast("long").alias("total_chars"),
        F.sum(row_digest(cols)).alias("digest_sum"),
        F.bit_xor(F.xxhash64(*[F.col(c) for c in cols])).alias("digest_xor"),
    )


def write_json_summary(df: DataFrame, path: str) -> None:
    """Write a (one-row, nested) summary as JSON; one output file."""
    df.coalesce(1).write.mode("overwrite").json(path)
