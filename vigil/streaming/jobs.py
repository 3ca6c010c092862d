"""Structured Streaming jobs: ingest, scoring, the periodic metrics refresh, hot model swap,
windowed metrics and the retraining cycle.

The monitored system polls a CSV every 60 s. Here the same work is a stream:

* `ingest`            file source with a fixed schema (parquet/csv/json folder).
* `score_stream`      ``model.transform`` on the stream, append to a sink.
* `MetricsRefresher`  ``foreachBatch``: fold the micro-batch into the latest-N window (bounded by
                      N), compute window accuracy with the current production model and
                      embedding drift against a matched reference sample; window and gauges are one
                      commit (`CommitLog`), so a restart goes on where the last commit ended.
* `ScoreSink`         ``foreachBatch``: score with the model in production at that moment, one commit a batch.
* `ModelCache`        reloads the production model only when the alias points elsewhere;
                      a withdrawn alias leaves no model.
* `windowed_metrics`  tumbling event-time windows with a watermark (late rows dropped
                      after the watermark passes); `windowed_metrics_batch` is its batch twin.

The retraining cycle is `vigil.plans.retrain`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators import sampling
from vigil.operators.evaluation import accuracy
from vigil.plans import lineage, training
from vigil.plans.monitoring import METRIC_NAMES, metrics_long, window_drift
from vigil.plans.retrain import LINEAGE
from vigil.functions.encoders import hashed_embedding
from vigil.session import scratch_path
from vigil.sources.commits import REPLACE, CommitLog
from vigil.sources.io import REVIEWS, conformed

METRIC_HISTORY = LINEAGE["metric_history"]


def ingest(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
           glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.load(folder)


def ingest_table(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """The Parquet table ``name`` of ``folder`` as a stream, be it one file or a folder of files. (A pattern: the
    file source takes a plain path for a folder, and a filter of file names sees only files.)"""
    return ingest(spark, f"{folder.rstrip('/')}/[{name[0]}]{name[1:]}.parquet", schema)


def run_to_parquet(stream: DataFrame, out: str, trigger_once: bool = True, output_mode: str = "append") -> DataFrame:
    """Run a stream over everything available into a Parquet sink; return the sink table."""
    q = (
        stream.writeStream.format("parquet").outputMode(output_mode)
        .option("path", out).option("checkpointLocation", out + "._checkpoint")
        .trigger(availableNow=trigger_once).start()
    )
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return stream.sparkSession.read.parquet(out)


def run_updates_to_parquet(stream: DataFrame, key: str, out: str) -> DataFrame:
    """Run an aggregating stream over everything available and return the newest row per
    ``key``, windows that the watermark still holds open included.

    Every micro-batch overwrites its own folder with the rows it changed, so that a replayed batch
    counts once; state is still bounded by the stream's watermark."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch_id=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (
        stream.writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", out + "._checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    newest = spark.read.parquet(out).groupBy(key).agg(
        F.max_by(F.struct(*[c for c in stream.columns if c != key]), "batch_id").alias("__row")
    )
    return newest.select(key, "__row.*").select(stream.columns)


def score_stream(model: PipelineModel, stream: DataFrame) -> DataFrame:
    return training.score(model, stream)


def windowed_metrics(stream: DataFrame, ts_col: str = "ts", label_col: str = "y", pred_col: str = "yhat",
                     value_col: str = "value", size: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Per tumbling event-time window: rows, accuracy and mean value."""
    et = stream.withColumn("__et", F.col(ts_col).cast("timestamp"))
    return (
        et.withWatermark("__et", watermark)
        .groupBy(F.window("__et", size).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg((F.col(label_col) == F.col(pred_col)).cast("double")).alias("accuracy"),
            F.avg(value_col).alias("mean_value"),
        )
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "accuracy", "mean_value")
    )


def windowed_metrics_batch(df: DataFrame, ts_col: str = "ts", label_col: str = "y", pred_col: str = "yhat",
                           value_col: str = "value", size: str = "1 hour") -> DataFrame:
    return (
        df.groupBy(F.window(F.col(ts_col).cast("timestamp_ntz"), size).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg((F.col(label_col) == F.col(pred_col)).cast("double")).alias("accuracy"),
            F.avg(value_col).alias("mean_value"),
        )
        .select(F.col("w.start").alias("window_start"), "n", "accuracy", "mean_value")
    )


class ModelCache:
    """Holds the production model; reloads only when the alias points to another version."""

    def __init__(self, resolve: Callable[[], tuple[int, str] | None]):
        self.resolve = resolve  # -> (version, path) or None
        self.version: int | None = None
        self.model: PipelineModel | None = None
        self.loads = 0

    def current(self) -> PipelineModel | None:
        found = self.resolve()
        if found is None:
            self.version = self.model = None  # the alias was withdrawn
            return None
        version, path = found
        if version != self.version:
            self.model = PipelineModel.load(path)
            self.version = version
            self.loads += 1
        return self.model


def lineage_resolver(spark: SparkSession, aliases_path: str, versions_path: str,
                     name: str = lineage.MODEL_NAME, alias: str = lineage.PROD_ALIAS):
    """A `ModelCache` resolver reading the append-only lineage tables: the version the
    alias currently points to and that version's model path (one row: bounded)."""

    def resolve() -> tuple[int, str] | None:
        try:
            events = spark.read.parquet(aliases_path).filter((F.col("name") == name) & (F.col("alias") == alias))
            versions = spark.read.parquet(versions_path).filter(F.col("name") == name)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None  # tables not written yet
        cur = lineage.current_alias(events)
        row = cur.join(versions.select("name", "version", "path"), ["name", "version"]).select("version", "path").first()
        return None if row is None else (int(row.version), row.path)

    return resolve


def newest_rows(rows: DataFrame, ts_col: str, id_col: str, n: int) -> DataFrame:
    """The latest ``n`` distinct rows (by time, then id, then content). Only times, ids and digests are
    compared and exchanged; whole rows are fetched for the ``n`` that stay."""
    others = [c for c in rows.columns if c not in (ts_col, id_col)]
    said = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in others])
    keyed = rows.withColumn("__digest", F.sha2(said, 256))
    keys = keyed.select(F.col(ts_col).alias("__ts"), F.col(id_col).alias("__id"), F.col("__digest").alias("__d")).distinct()
    newest = keys.orderBy(F.col("__ts").desc_nulls_last(), F.col("__id").desc_nulls_last(), F.col("__d").desc()).limit(n)
    same = F.col(ts_col).eqNullSafe(F.col("__ts")) & F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__d"))
    kept = keyed.join(F.broadcast(newest), same, "left_semi")  # `newest` has at most n narrow rows
    return kept.dropDuplicates([ts_col, id_col, "__digest"]).drop("__digest")


def batch_key(run_id: str, batch_id: int, rows: DataFrame) -> str:
    """A key of a micro-batch: its number and a digest of its rows. The same batch has the same key when it is
    replayed; another one does not, even if a fresh stream checkpoint gives it the same number."""
    digest = rows.select(F.xxhash64(*rows.columns).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s"), F.bit_xor("h").alias("x")
    ).first()  # one row
    return f"{run_id}:{batch_id}:{digest.n}:{digest.s}:{digest.x}"


class MetricsRefresher:
    """foreachBatch body for the periodic refresh.

    Its state is in the commit log: the window of the latest ``window`` distinct rows and the metric history. A
    micro-batch stages the new window, measures it, stages the gauges and commits both under the batch's key. A crash
    before the commit leaves no trace; a replayed batch finds its key; a restart, also with a fresh stream
    checkpoint, goes on from the committed window, in which rows that come again count once.

    Every gauge has a status: ``ok``, ``no_data`` (empty window), ``no_model``, or ``insufficient_reference``
    (fewer reference rows than the window); values are 0.0 but for ``ok``. ``reference_version`` names the state of the
    reference table: the matched sample is drawn again when it changes."""

    def __init__(self, spark: SparkSession, reference: DataFrame, root: str, window: int = 200,
                 models: ModelCache | None = None, seed: int = 42, id_col: str = "review_id",
                 ts_col: str = "ts", text_col: str = "review", label_col: str = "sentiment",
                 run_id: str = "monitor", reference_version: Callable[[], object] = lambda: 0):
        self.spark, self.reference, self.reference_version = spark, reference, reference_version
        self.window, self.models, self.seed, self.run_id = window, models, seed, run_id
        self.cols = (id_col, ts_col, text_col, label_col)
        self.log = CommitLog(spark, root, {"window": REVIEWS, "metric_history": METRIC_HISTORY})
        self._sample: tuple | None = None

    def _reference_sample(self, n: int) -> DataFrame:
        """The seeded reference sample of size n, drawn once per size and state of the reference and
        kept as a small table (bounded by the window)."""
        state = (self.reference_version(), n)
        if self._sample is None or self._sample[0] != state:
            path = scratch_path(self.spark, f"reference-sample-{n}")
            sampling.exact_sample(self.reference, self.cols[0], n, self.seed).write.parquet(path)
            self._sample = (state, path)
        return self.spark.read.parquet(self._sample[1])

    def history(self) -> DataFrame:
        return self.log.read("metric_history")

    def window_rows(self) -> DataFrame:
        return self.log.read("window")

    def _accuracy(self, window: DataFrame, n: int) -> tuple[DataFrame, str]:
        model = self.models.current() if self.models else None
        if n == 0 or model is None:
            return self.spark.range(1).select(F.lit(0.0).alias("accuracy")), "no_data" if n == 0 else "no_model"
        return accuracy(training.score(model, window), "sentiment", "prediction").select("accuracy"), "ok"

    def _drift(self, window: DataFrame, n: int) -> tuple[DataFrame, str]:
        text_col = self.cols[2]
        status = "no_data"
        if n > 0:
            ref = self._reference_sample(n)
            if ref.count() >= n:
                return window_drift(hashed_embedding(ref, text_col), hashed_embedding(window, "review")), "ok"
            status = "insufficient_reference"
        names = ("combined_drift_score", "semantic_ks", "centroid_distance", "spread_distance")
        return self.spark.range(1).select(*[F.lit(0.0).alias(c) for c in names]), status

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        renamed = [F.col(c).alias(n) for c, n in zip(self.cols, ("review_id", "ts", "review", "sentiment"))]
        rows = conformed(batch.select(*renamed), REVIEWS)
        key = batch_key(self.run_id, batch_id, rows)
        if self.log.has(key):
            return
        latest = newest_rows(rows.unionByName(self.log.read("window")), "ts", "review_id", self.window)
        staged = self.log.stage("window", latest, REPLACE)
        window = self.log.staged_rows(staged)
        n = window.count()
        acc, acc_status = self._accuracy(window, n)
        drift, drift_status = self._drift(window, n)
        status = F.when(F.col("metric") == METRIC_NAMES[0], acc_status).otherwise(drift_status)
        gauges = metrics_long(acc, drift).select(
            F.current_timestamp().alias("ts"), F.lit(self.run_id).alias("run_id"),
            F.lit(batch_id).cast("long").alias("batch_id"), "metric", "value", status.alias("status"),
        )
        self.log.commit(key, [staged, self.log.stage("metric_history", gauges)])


class ScoreSink:
    """foreachBatch body that scores with the model in production when the batch runs. Each batch is one
    commit under its key, so a replay adds no rows and keeps the scores first committed; a promotion
    changes later batches only. Without a model a batch is an error, to be replayed."""

    def __init__(self, spark: SparkSession, root: str, models: ModelCache, schema: T.StructType, run_id: str = "scores"):
        fields = [("prediction", T.IntegerType()), ("prediction_label", T.StringType()), ("p1", T.DoubleType()), ("model_version", T.IntegerType())]
        scored = T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in fields]])
        self.models, self.run_id, self.log = models, run_id, CommitLog(spark, root, {"scores": scored})

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        key = batch_key(self.run_id, batch_id, batch)
        if self.log.has(key):
            return
        model = self.models.current()
        if model is None:
            raise RuntimeError("no model is in production")
        scored = training.score(model, batch).withColumn("model_version", F.lit(self.models.version))
        self.log.commit(key, [self.log.stage("scores", scored)])

    def scores(self) -> DataFrame:
        return self.log.read("scores")


def refresh_stream(stream: DataFrame, refresher: Callable[[DataFrame, int], None], checkpoint: str,
                   interval: str | None = "60 seconds", available_now: bool = False):
    w = stream.writeStream.foreachBatch(refresher).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


__all__ = ["METRIC_NAMES", "ingest", "run_to_parquet", "score_stream", "windowed_metrics", "windowed_metrics_batch",
           "ModelCache", "MetricsRefresher", "ScoreSink", "refresh_stream"]
