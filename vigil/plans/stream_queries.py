"""Streaming queries: each runs a Structured Streaming job over the given tables (file
source, ``availableNow`` trigger) into a sink below the checkpoint folder and returns
the sink table; `windowed_metrics` is the batch twin with a SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.plans import lineage, retrain
from vigil.plans.catalog import register, rounded
from vigil.session import scratch_path
from vigil.sources import tables
from vigil.streaming import jobs
from vigil.streaming.late import LateAwareWindows


def _events_stream(spark, sf_dir):
    schema = tables.table(spark, sf_dir, "events").schema
    return jobs.ingest_table(spark, sf_dir, "events", schema)


def _scored_events(df):
    return df.select(
        "event_id", "ts", "value",
        (F.col("event_type") == "purchase").cast("int").alias("y"),
        (F.col("value") >= F.lit(50.0)).cast("int").alias("yhat"),
    )


WINDOWED_METRICS = """SELECT date_trunc('hour', ts) AS window_start, count(*) AS n,
       round(avg(CAST((event_type = 'purchase') = (value >= 50.0) AS DOUBLE)), 6) AS accuracy,
       round(avg(value), 6) AS mean_value
FROM events GROUP BY 1"""


@register("windowed_metrics", WINDOWED_METRICS)
def q_windowed_metrics(spark, sf_dir):
    ev = _scored_events(tables.table(spark, sf_dir, "events"))
    return rounded(jobs.windowed_metrics_batch(ev))


@register("stream_windowed_metrics", WINDOWED_METRICS)
def q_stream_windowed_metrics(spark, sf_dir):
    stream = _scored_events(_events_stream(spark, sf_dir))
    out = scratch_path(spark, "stream-windows")
    return rounded(jobs.run_updates_to_parquet(jobs.windowed_metrics(stream), "window_start", out))


# Arrival: four equal spans of event time one after the other; every tenth event comes with the next span.
ARRIVALS = 5


@register(
    "stream_late_rows",
    """WITH span AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
e AS (SELECT date_trunc('hour', ts) AS w, ts, value, (event_type = 'purchase') = (value >= 50.0) AS correct,
        4 * (epoch_us(ts) - epoch_us(lo)) // (epoch_us(hi) - epoch_us(lo) + 1) + CAST(event_id % 10 = 0 AS INTEGER) AS arrival
      FROM events, span),
marks AS (SELECT a.arrival, max(b.ts) - INTERVAL 2 HOUR AS mark
          FROM (SELECT DISTINCT arrival FROM e) a JOIN (SELECT arrival, max(ts) AS ts FROM e GROUP BY 1) b ON b.arrival < a.arrival GROUP BY 1),
judged AS (SELECT e.*, coalesce(w + INTERVAL 1 HOUR <= mark, false) AS late FROM e LEFT JOIN marks USING (arrival))
SELECT w AS window_start, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS n_late,
       round(avg(CAST(correct AS DOUBLE)) FILTER (NOT late), 6) AS accuracy, round(avg(value) FILTER (NOT late), 6) AS mean_value
FROM judged GROUP BY 1""",
)
def q_stream_late_rows(spark, sf_dir):
    """Windows of what came on time and, beside them, how many rows of each window came behind the watermark."""
    events = tables.table(spark, sf_dir, "events")
    span = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))  # one row
    us = "unix_micros(CAST({} AS TIMESTAMP))".format
    quarter = F.expr(f"4 * ({us('ts')} - {us('lo')}) div ({us('hi')} - {us('lo')} + 1)")
    arrival = quarter + (F.col("event_id") % 10 == 0).cast("int")
    arriving = events.crossJoin(F.broadcast(span)).withColumn("arrival", arrival).drop("lo", "hi")
    feed, root = scratch_path(spark, "event-feed"), scratch_path(spark, "late-windows")
    sink = LateAwareWindows(spark, root, _scored_events(events).schema)
    for k in range(ARRIVALS):  # each run of the stream takes what has arrived since the last one
        arriving.filter(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(feed)
        stream = _scored_events(jobs.ingest(spark, feed, events.schema))
        jobs.refresh_stream(stream, sink, root + "/checkpoint", available_now=True).awaitTermination()
    late = sink.late_rows().groupBy(F.col("late_window").alias("window_start")).agg(F.count(F.lit(1)).alias("n_late"))
    none = F.lit(0).cast("long")
    return rounded(sink.windows().join(late, "window_start", "full").select(
        "window_start", F.coalesce("n", none).alias("n"), F.coalesce("n_late", none).alias("n_late"), "accuracy", "mean_value"
    ))


@register("stream_score")
def q_stream_score(spark, sf_dir):
    from vigil.plans.model_queries import fitted

    _, fm = fitted(spark, sf_dir)
    schema = tables.table(spark, sf_dir, "documents").schema
    docs = jobs.ingest_table(spark, sf_dir, "documents", schema).select(
        F.col("doc_id").alias("review_id"), F.col("text").alias("review")
    )
    out = scratch_path(spark, "stream-score")
    return rounded(jobs.run_to_parquet(jobs.score_stream(fm.model, docs), out).select("review_id", "prediction", "p1"))


def _events_as_reviews(df):
    return df.select(
        F.col("event_id").alias("review_id"), "ts", F.col("props").alias("review"),
        (F.col("event_type") == "purchase").cast("int").alias("sentiment"),
    )


@register("stream_latest_window")
def q_stream_latest_window(spark, sf_dir):
    from vigil.plans.model_queries import fitted

    _, fm = fitted(spark, sf_dir)
    log = retrain.lineage_log(spark, scratch_path(spark, "lineage"))
    model_path = f"{log.root}/models/fitted"
    fm.model.write().overwrite().save(model_path)
    # register and promote the model in the lineage tables; the refresher resolves it there
    version = spark.range(1).select(
        F.lit(lineage.MODEL_NAME).alias("name"), F.lit(1).alias("version"), F.lit("fitted").alias("run_id"),
        F.lit(model_path).alias("path"),
    )
    log.put("fitted", append={"model_versions": version})
    retrain.promote(log, 1)
    cache = jobs.ModelCache(retrain.production(log))
    stream = _events_as_reviews(_events_stream(spark, sf_dir))
    root = scratch_path(spark, "monitor")
    refresher = jobs.MetricsRefresher(spark, tables.lang_reviews(spark, sf_dir), root, 200, cache)
    q = jobs.refresh_stream(stream, refresher, root + "/checkpoint", available_now=True)
    q.awaitTermination()
    return rounded(refresher.history().select("batch_id", "metric", "value", "status"))


@register(
    "stream_window_rows",
    """SELECT event_id AS review_id, ts, props AS review, CAST(event_type = 'purchase' AS INTEGER) AS sentiment
FROM events ORDER BY ts DESC, event_id DESC LIMIT 200""",
)
def q_stream_window_rows(spark, sf_dir):
    """The committed window after a stream over several files, read once more from a fresh stream
    checkpoint by a restarted refresher: rows that come again count once."""
    events = tables.table(spark, sf_dir, "events")
    feed = scratch_path(spark, "event-feed")
    events.repartitionByRange(2, "event_id").write.parquet(feed)
    root = scratch_path(spark, "monitor")
    for attempt, files in enumerate((1, 2)):
        refresher = jobs.MetricsRefresher(spark, tables.lang_reviews(spark, sf_dir), root)
        stream = _events_as_reviews(jobs.ingest(spark, feed, events.schema, max_files_per_trigger=files))
        q = jobs.refresh_stream(stream, refresher, f"{root}/checkpoint-{attempt}", available_now=True)
        q.awaitTermination()
    return refresher.window_rows().select("review_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "review", "sentiment")


def _seeded_log(spark, sf_dir):
    """A log that holds the reviews and, appended as one batch, the events as monitoring rows."""
    log = retrain.lineage_log(spark, scratch_path(spark, "lineage"))
    log.put("base", replace={"reviews": tables.lang_reviews(spark, sf_dir)})
    retrain.append_monitoring_batch(log, tables.new_reviews(spark, sf_dir), "events")
    return log


@register("retrain_cycle")
def q_retrain_cycle(spark, sf_dir):
    return rounded(retrain.retrain(_seeded_log(spark, sf_dir), "run-1").drop("run_id"))


@register(
    "retrain_fold",
    """WITH ranked AS (
  SELECT event_id, CAST(event_type = 'purchase' AS INTEGER) AS sentiment,
         row_number() OVER (ORDER BY md5('42:' || event_id), event_id) AS rk FROM events),
folded AS (SELECT * FROM ranked WHERE rk > 200)
SELECT 'new_reviews' AS table_name, event_id AS review_id, sentiment FROM ranked WHERE rk <= 200
UNION ALL SELECT 'reviews', doc_id, CAST(lang = 'en' AS INTEGER) FROM documents
UNION ALL SELECT 'reviews', (SELECT max(doc_id) FROM documents) + 1 + event_id - (SELECT min(event_id) FROM folded), sentiment FROM folded""",
)
def q_retrain_fold(spark, sf_dir):
    """Training and monitoring table after a committed fold, and after the same fold called again."""
    log = _seeded_log(spark, sf_dir)
    for _ in range(2):
        retrain.fold(log, "run-1")
    both = [log.read(t).select(F.lit(t).alias("table_name"), "review_id", "sentiment") for t in ("new_reviews", "reviews")]
    return both[0].unionByName(both[1])
