"""Retraining as two commits: fold the monitoring rows into the training table, then fit, evaluate,
log and register.

All tables are in one commit log (`vigil.sources.commits`): reviews, new_reviews, runs, metric_history,
model_versions, model_aliases. Each step commits under a key made of the run id, so a run that died is
called again with the same id: a finished step is not repeated, an unfinished one left nothing behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators import sampling
from vigil.plans import lineage, training
from vigil.session import ensure_checkpoint_dir
from vigil.sources.commits import CommitLog
from vigil.sources.io import REVIEWS

_STRING, _TIME, _TEXTS = T.StringType(), T.TimestampType(), T.MapType(T.StringType(), T.StringType())


def _columns(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


LINEAGE = {
    "reviews": REVIEWS,
    "new_reviews": REVIEWS,
    "runs": _columns(
        run_id=_STRING, run_name=_STRING, started=_TIME, tags=_TEXTS, params=_TEXTS, schema_json=_STRING,
        input_example=T.ArrayType(_STRING),
    ),
    "metric_history": _columns(
        ts=_TIME, run_id=_STRING, batch_id=T.LongType(), metric=_STRING, value=T.DoubleType(), status=_STRING
    ),
    "model_versions": _columns(
        name=_STRING, version=T.IntegerType(), run_id=_STRING, path=_STRING, accuracy=T.DoubleType(), started=_TIME
    ),
    "model_aliases": _columns(name=_STRING, alias=_STRING, version=T.IntegerType(), ts=_TIME),
}


def lineage_log(spark: SparkSession, root: str) -> CommitLog:
    return CommitLog(spark, root, LINEAGE)


def append_monitoring_batch(log: CommitLog, rows: DataFrame, key: str, batch_ts=None) -> bool:
    """Append a batch of labelled rows to the monitoring table, stamped with the batch's time where they have
    none of their own. A key that was committed adds nothing."""
    if batch_ts is not None:
        stamp = F.lit(batch_ts).cast("timestamp")
        rows = rows.withColumn("ts", F.coalesce(F.col("ts"), stamp) if "ts" in rows.columns else stamp)
    return log.put(key, append={"new_reviews": rows})


def disjoint_ids(base: DataFrame, new: DataFrame, id_col: str = "review_id") -> DataFrame:
    """``new`` with its ids moved behind the largest of ``base``, distances kept: no id is in both. Null
    ids stay null."""
    top = base.agg(F.coalesce(F.max(id_col), F.lit(-1)).alias("__top"))
    least = new.agg(F.min(id_col).alias("__least"))
    moved = new.crossJoin(F.broadcast(top.crossJoin(least)))  # one row
    return moved.withColumn(id_col, F.col("__top") + F.lit(1) + F.col(id_col) - F.col("__least")).drop("__top", "__least")


def fold(log: CommitLog, run_id: str, window: int = 200, mode: str = "random", seed: int = 42) -> bool:
    """Hold back the window of the monitoring table, append the rest to the training table: one commit. The kept
    rows are written in order of time."""
    key = f"{run_id}:fold"
    if log.has(key):
        return False
    ensure_checkpoint_dir(log.spark)
    new = log.read("new_reviews")
    held = sampling.holdback(new, "review_id", "ts", window, mode, seed).checkpoint(eager=True)
    appended = held.filter(F.col("action") == "append").drop("action")
    kept = held.filter(F.col("action") == "keep").drop("action").sortWithinPartitions("ts", "review_id")
    return log.put(key, append={"reviews": disjoint_ids(log.read("reviews"), appended)}, replace={"new_reviews": kept})


def train(log: CommitLog, run_id: str, gate: float = lineage.GATE, seed: int = 42, started=None, **fit) -> bool:
    """Fit on the training table, evaluate both splits, and commit the run, its metrics and, above the gate, the
    next model version, all at once. The model is saved before, below the log's root."""
    key = f"{run_id}:train"
    if log.has(key):
        return False
    spark = log.spark
    ensure_checkpoint_dir(spark)
    split = sampling.exact_split(log.read("reviews"), "review_id", 0.2, seed).checkpoint(eager=True)
    rows = split.filter(F.col("split") == "train")
    fitted = training.fit(rows, **fit)
    path = f"{log.root}/models/{run_id}"
    fitted.model.write().overwrite().save(path)
    needed = ["sentiment", "prediction", "p1", "split"]
    scored = training.score(fitted.model, split).select(*needed).checkpoint(eager=True)
    test = training.evaluate(scored.filter(F.col("split") == "test")).checkpoint(eager=True)  # one row
    learnt = training.evaluate(scored.filter(F.col("split") == "train"), prefix="training_")
    now = F.current_timestamp() if started is None else F.lit(started).cast("timestamp")
    metrics = lineage.run_metrics(test, run_id).unionByName(lineage.run_metrics(learnt, run_id, prefix="training_"))
    number = log.read("runs").count() + 1
    params = {**fitted.params, "n_train": str(fitted.n_train)}
    run = lineage.run_record(spark, run_id, number, params, rows, started=started)
    top = log.read("model_versions").agg(F.coalesce(F.max("version"), F.lit(0)).alias("__top"))  # one row
    version = test.crossJoin(top).filter(F.col("test_accuracy") > F.lit(gate)).select(
        F.lit(lineage.MODEL_NAME).alias("name"), (F.col("__top") + 1).cast("int").alias("version"),
        F.lit(run_id).alias("run_id"), F.lit(path).alias("path"), F.col("test_accuracy").alias("accuracy"), now.alias("started"),
    )
    return log.put(key, append={"runs": run, "metric_history": metrics.withColumn("ts", now), "model_versions": version})


def retrain(log: CommitLog, run_id: str, window: int = 200, mode: str = "random", seed: int = 42,
            gate: float = lineage.GATE, **fit) -> DataFrame:
    """One retraining run, from the first step of it that is not committed; returns its report."""
    fold(log, run_id, window, mode, seed)
    train(log, run_id, gate, seed, **fit)
    return report(log, run_id)


def report(log: CommitLog, run_id: str) -> DataFrame:
    """One row from the committed tables: run_id, n_train, the seven test metrics, registered, candidate_version."""
    metrics = log.read("metric_history").filter((F.col("run_id") == run_id) & F.col("metric").startswith("test_"))
    wide = metrics.groupBy("run_id").agg(
        *[F.max(F.when(F.col("metric") == f"test_{m}", F.col("value"))).alias(f"test_{m}") for m in lineage.RUN_METRICS]
    )
    runs = log.read("runs").filter(F.col("run_id") == run_id).select("run_id", F.col("params")["n_train"].cast("long").alias("n_train"))
    version = log.read("model_versions").filter(F.col("run_id") == run_id).select("run_id", F.col("version").alias("candidate_version"))
    return runs.join(wide, "run_id", "left").join(version, "run_id", "left").withColumn(
        "registered", F.col("candidate_version").isNotNull()
    )


def promote(log: CommitLog, version: int, ts=None) -> bool:
    """Point the production alias to ``version``."""
    event = lineage.promote(log.spark, version, ts=ts)
    return log.put(f"promote:{version}:{log.version()}", append={"model_aliases": event})


def champion(log: CommitLog) -> DataFrame:
    """The version in production with the test accuracy logged for its run."""
    return lineage.champion(log.read("model_aliases"), log.read("model_versions"), log.read("metric_history"))


def production(log: CommitLog):
    """A resolver for `ModelCache`: (version, path) of the version in production, or None."""

    def resolve() -> tuple[int, str] | None:
        events = log.read("model_aliases").filter((F.col("name") == lineage.MODEL_NAME) & (F.col("alias") == lineage.PROD_ALIAS))
        versions = log.read("model_versions").select("name", "version", "path")
        row = lineage.current_alias(events).join(versions, ["name", "version"]).select("version", "path").first()
        return None if row is None else (int(row.version), row.path)

    return resolve
