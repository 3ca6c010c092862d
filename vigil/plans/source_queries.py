"""Source/sink queries: CSV round trip and ingest, JSON records, fingerprint, append by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.plans.catalog import register
from vigil.session import scratch_path
from vigil.sources import io, quarantine, tables
from vigil.sources.commits import CommitLog
from vigil.sources.per_file import Manifest


@register("csv_roundtrip", "SELECT doc_id, text FROM documents")
def q_csv_roundtrip(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "csv-roundtrip")
    io.write_csv(docs, path)
    return io.read_csv(spark, path, "doc_id BIGINT, text STRING")


@register(
    "csv_ingest",
    """SELECT d.text AS review, l.quality AS sentiment, NULL::TIMESTAMP AS ts FROM documents d JOIN labels l ON d.doc_id = l.doc_id
UNION ALL
SELECT props, CAST(event_type = 'purchase' AS INTEGER), date_trunc('second', ts) FROM events""",
)
def q_csv_ingest(spark, sf_dir):
    """Training rows as `Review,Sentiment` CSV plus monitoring rows as
    `Timestamp,Review,Sentiment` CSV, read back by header and appended by name."""
    base = tables.reviews(spark, sf_dir).select(F.col("review").alias("Review"), F.col("sentiment").alias("Sentiment"))
    ev = tables.new_reviews(spark, sf_dir).select(
        F.date_format("ts", io.TS_FORMAT).alias("Timestamp"),
        F.col("review").alias("Review"),
        F.col("sentiment").alias("Sentiment"),
    )
    p1, p2 = scratch_path(spark, "csv-base"), scratch_path(spark, "csv-new")
    io.write_csv(base, p1)
    io.write_csv(ev, p2)
    both = io.append_by_name(io.read_reviews_csv(spark, p1), io.read_reviews_csv(spark, p2))
    return both.select("review", "sentiment", F.col("ts").cast("timestamp_ntz").alias("ts"))


@register(
    "csv_quarantine",
    """SELECT event_id AS review_id,
  CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN NULL ELSE props END AS review,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_type = 'purchase' AS INTEGER) END AS sentiment,
  CASE WHEN event_id % 7 = 0 THEN 'Sentiment does not parse' WHEN event_id % 11 = 0 THEN 'Timestamp does not parse' END AS reason
FROM events""",
)
def q_csv_quarantine(spark, sf_dir):
    """Monitoring rows with empty, missing and damaged fields through CSV: good rows and rejects, every row once."""
    ev = tables.new_reviews(spark, sf_dir)
    i = F.col("review_id")
    path = scratch_path(spark, "csv-damaged")
    io.write_csv(ev.select(
        F.when(i % 11 == 0, "yesterday").otherwise(F.date_format("ts", io.TS_FORMAT)).alias("Timestamp"),
        F.when(i % 5 == 0, "").when(i % 5 == 1, F.lit(None)).otherwise(F.col("review")).alias("Review"),
        F.when(i % 7 == 0, "many").otherwise(F.col("sentiment").cast("string")).alias("Sentiment"), i,
    ), path)
    both = quarantine.divided(io.judged_reviews_csv(spark, path), scratch_path(spark, "csv-divided"))
    good = both.good.withColumn("reason", F.lit(None).cast("string"))
    return good.unionByName(both.rejects.drop("raw")).select("review_id", "review", "sentiment", "reason")


@register(
    "json_extract",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events
WHERE CAST(json_extract(props, '$.k') AS INTEGER) IS NOT NULL""",
)
def q_json_extract(spark, sf_dir):
    ev = tables.table(spark, sf_dir, "events").select("event_id", "props")
    return io.parse_json_records(ev, "props", "array<struct<k:int>>", ("k",))


@register(
    "dataset_fingerprint",
    """SELECT count(*) AS n_rows, sum(length(text))::BIGINT AS total_chars,
       CAST(sum(('0x' || substr(md5(concat_ws(chr(1), coalesce(CAST(doc_id AS VARCHAR), chr(0)),
                                               coalesce(text, chr(0)))), 1, 8))::BIGINT) AS VARCHAR) AS digest_sum
FROM documents""",
)
def q_dataset_fingerprint(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    fp = io.fingerprint(docs, ["doc_id", "text"], "text")
    return fp.select("n_rows", "total_chars", F.col("digest_sum").cast("string").alias("digest_sum"))


_DIGEST = """sum(('0x' || substr(md5(concat_ws(chr(1), coalesce(CAST(doc_id AS VARCHAR), chr(0)), coalesce(text, chr(0)))), 1, 8))::BIGINT)"""


@register(
    "dataset_manifest",
    f"""SELECT 'reviews' AS name, 'sentiment' AS target, CAST(2 AS BIGINT) AS n_files, count(*) AS n_rows,
       CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS total_chars, CAST({_DIGEST} AS VARCHAR) AS digest_sum
FROM documents WHERE doc_id % 3 <> 1""",
)
def q_dataset_manifest(spark, sf_dir):
    """The manifest row of a folder in which one of two files was replaced by another: the one that stayed is
    not read again. Each file is written in parts, by all tasks."""
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch_path(spark, "dataset")
    manifest = Manifest(CommitLog(spark, scratch_path(spark, "manifest"), {}), ["doc_id", "text"], "text")

    def part(k: int, name: str) -> None:
        docs.filter(F.col("doc_id") % 3 == k).write.mode("overwrite").parquet(f"{folder}/{name}/reviews.parquet")

    part(0, "day=1")
    part(1, "day=2")
    manifest.update(folder)
    part(2, "day=2")
    row = manifest.row(folder, "reviews", "sentiment")
    return row.select("name", "target", "n_files", "n_rows", "total_chars", F.col("digest_sum").cast("string").alias("digest_sum"))


@register(
    "append_by_name",
    """SELECT d.doc_id AS review_id, d.text AS review, l.quality AS sentiment, NULL::TIMESTAMP AS ts
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
UNION ALL
SELECT event_id, props, CAST(event_type = 'purchase' AS INTEGER), ts FROM events""",
)
def q_append_by_name(spark, sf_dir):
    base = tables.reviews(spark, sf_dir)
    new = tables.new_reviews(spark, sf_dir).select("review_id", "review", "sentiment", "ts")
    return io.append_by_name(base, new)
