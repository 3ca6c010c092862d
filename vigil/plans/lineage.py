"""Model lineage as append-only tables: runs, model versions, aliases, metric history.

Tables (Parquet folders below a lineage root; every change is an append, the current
state is a grouped ``max_by``, so concurrent writers never rewrite a file):
  runs            run_id, run_name, started, tags MAP, params MAP, schema_json, input_example
  model_versions  name, version, run_id, path, accuracy
  model_aliases   name, alias, version, ts           (append-only alias events)
  metric_history  ts, run_id, batch_id, metric, value
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.cumulative import row_sequence

# Fixed values of the monitored system's model registry: model name, production alias,
# registration gate (strict: test accuracy must be above it), run tags, run-name format.
MODEL_NAME = "sentiment-classifier"
PROD_ALIAS = "prod"
GATE = 0.8
RUN_NAME_FORMAT = "sentiment_model_v%d_%s"
RUN_TAGS = {
    "model_type": "sentiment_classifier",
    "algorithm": "logistic_regression",
    "feature_extraction": "tfidf",
    "created_by": "training_pipeline",
}


def local_time(df: DataFrame, ts_col: str, tz: str = "Asia/Jakarta"):
    """Wall-clock time in ``tz`` (TIMESTAMP_NTZ), independent of the session time zone.

    A TIMESTAMP_NTZ column is taken as UTC wall-clock time; a TIMESTAMP column is an
    instant."""
    from pyspark.sql.types import TimestampNTZType

    col = F.col(ts_col)
    if isinstance(df.schema[ts_col].dataType, TimestampNTZType):
        return F.convert_timezone(F.lit("UTC"), F.lit(tz), col)
    return F.convert_timezone(None, F.lit(tz), col)


def local_stamp(df: DataFrame, ts_col: str, tz: str = "Asia/Jakarta", fmt: str = "yyyyMMdd_HHmmss"):
    """Local wall-clock time formatted as text (run names, snapshot tags)."""
    return F.date_format(local_time(df, ts_col, tz), fmt)


def run_name(version, stamp):
    """sentiment_model_v{n}_{yyyyMMdd_HHmmss}."""
    return F.format_string(RUN_NAME_FORMAT, version, stamp)


def next_version(runs: DataFrame) -> DataFrame:
    """One row: next_version = number of existing runs + 1."""
    return runs.agg((F.count(F.lit(1)) + F.lit(1)).alias("next_version"))


def register_passing(runs_with_accuracy: DataFrame, existing_max: int = 0, gate: float = GATE,
                     name: str = MODEL_NAME) -> DataFrame:
    """Versions for runs whose accuracy is strictly above the gate, numbered in
    (started, run_id) order after ``existing_max``."""
    passing = runs_with_accuracy.filter(F.col("accuracy") > F.lit(gate))
    seq = row_sequence(passing.select("run_id", "started", "accuracy"), ["started", "run_id"], "seq")
    return seq.select(
        F.lit(name).alias("name"),
        (F.col("seq") + F.lit(existing_max)).cast("int").alias("version"),
        "run_id",
        F.format_string("runs:/%s/sentiment-model", F.col("run_id")).alias("path"),
        "accuracy",
        "started",
    )


def latest_versions(versions: DataFrame) -> DataFrame:
    """Per model name, the highest version with its run and accuracy (grouped max_by)."""
    return versions.groupBy("name").agg(
        F.max("version").alias("version"),
        F.max_by(F.struct("run_id", "accuracy"), "version").alias("v"),
    ).select("name", "version", F.col("v.run_id").alias("run_id"), F.col("v.accuracy").alias("accuracy"))


def current_alias(alias_events: DataFrame) -> DataFrame:
    """Per (name, alias), the version of the latest alias event (ties: larger version)."""
    return alias_events.groupBy("name", "alias").agg(
        F.max_by("version", F.struct("ts", "version")).alias("version")
    )


def promote(spark: SparkSession, version: int, name: str = MODEL_NAME, alias: str = PROD_ALIAS,
            ts=None) -> DataFrame:
    """One alias event moving ``alias`` to ``version`` (append it to ``model_aliases``; the
    current alias is then recomputed by `current_alias`, and the candidate clears because
    `champion_vs_candidate` compares versions)."""
    return spark.range(1).select(
        F.lit(name).alias("name"),
        F.lit(alias).alias("alias"),
        F.lit(version).cast("int").alias("version"),
        (F.current_timestamp() if ts is None else F.lit(ts).cast("timestamp")).alias("ts"),
    )


def champion(alias_events: DataFrame, versions: DataFrame, run_metrics: DataFrame,
             alias: str = PROD_ALIAS, metric: str = "test_accuracy_score") -> DataFrame:
    """Per model name, the version the alias points to, its run and its accuracy
    (0.0 when the run or metric is missing); models without the alias get no row."""
    cur = current_alias(alias_events.filter(F.col("alias") == alias))
    # `cur` has one row per model: the large version and metric tables are first cut to
    # the rows it points at, so the outer joins below see one row per model. The number of
    # models is unbounded: whether to broadcast is left to the sizes Spark measures.
    wanted = cur.select("name", "version")
    v = versions.select("name", "version", "run_id").join(wanted, ["name", "version"], "left_semi")
    m = (
        run_metrics.filter(F.col("metric") == metric)
        .join(v.select("run_id"), "run_id", "left_semi")
        .groupBy("run_id")
        .agg(F.max_by("value", "ts").alias("metric_value"))
    )
    return (
        cur.join(v, ["name", "version"], "left")
        .join(m, "run_id", "left")
        .select(
            "name",
            "version",
            F.coalesce(F.col("run_id"), F.lit("N/A")).alias("run_id"),
            F.coalesce(F.col("metric_value"), F.lit(0.0)).alias("accuracy"),
        )
    )


def champion_vs_candidate(champ: DataFrame, candidate: DataFrame) -> DataFrame:
    """Side by side per model name (full outer: either may be missing)."""
    c = champ.select("name", F.col("version").alias("champion_version"), F.col("accuracy").alias("champion_accuracy"))
    d = candidate.select("name", F.col("version").alias("candidate_version"), F.col("accuracy").alias("candidate_accuracy"))
    return c.join(d, "name", "full_outer")


def latest_metrics(history: DataFrame) -> DataFrame:
    """Current gauge values: per metric, the value of the latest row (ties: larger batch)."""
    return history.groupBy("metric").agg(
        F.max_by("value", F.struct("ts", "batch_id")).alias("value"), F.max("ts").alias("ts")
    )


def drift_alerts(history: DataFrame, threshold: float, metric: str = "drift_score") -> DataFrame:
    """Rows of the metric history whose value exceeds a (mandatory) threshold."""
    return history.filter((F.col("metric") == metric) & (F.col("value") > F.lit(threshold)))


# The seven metrics logged with a run, behind the prefix of the split, and the
# columns of `training.evaluate` they come from.
RUN_METRICS = {
    "accuracy_score": "accuracy",
    "precision_score": "precision",
    "recall_score": "recall",
    "f1_score": "f1_score",
    "roc_auc": "roc_auc",
    "log_loss": "log_loss",
    "score": "accuracy",
}


def run_metrics(evaluated: DataFrame, run_id: str, prefix: str = "test_", log_prefix: str | None = None, ts=None) -> DataFrame:
    """One row of `training.evaluate` -> the run's seven rows of the metric history. A metric that is undefined
    (AUC of one class) has a null value and status 'undefined'."""
    log_prefix = prefix if log_prefix is None else log_prefix
    wide = evaluated.select(*[F.col(f"{prefix}{c}").alias(f"{log_prefix}{m}") for m, c in RUN_METRICS.items()])
    return wide_to_long(wide, run_id, ts=ts).withColumn("status", F.when(F.col("value").isNull(), "undefined").otherwise("ok"))


def wide_to_long(metrics_row: DataFrame, run_id: str, batch_id: int | None = None, ts=None) -> DataFrame:
    """A one-row wide metrics frame -> metric_history rows."""
    cols = [c for c in metrics_row.columns]
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = metrics_row.selectExpr(f"stack({len(cols)}, {pairs}) AS (metric, value)")
    return long.select(
        (F.current_timestamp() if ts is None else F.lit(ts)).alias("ts"),
        F.lit(run_id).alias("run_id"),
        F.lit(batch_id).cast("long").alias("batch_id"),
        "metric",
        "value",
    )


def run_record(spark: SparkSession, run_id: str, version: int, params: dict, train: DataFrame,
               id_col: str = "review_id", text_col: str = "review", started=None) -> DataFrame:
    """One runs row: name, tags, params, input schema and a 5-row input example."""
    example = train.orderBy(id_col).limit(5).select(text_col)  # bounded: 5 rows
    tags = dict(RUN_TAGS, version=f"v{version}")
    base = spark.range(1).select(
        F.lit(run_id).alias("run_id"),
        (F.current_timestamp() if started is None else F.lit(started)).alias("started"),
        F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), F.lit(v))]).alias("tags"),
        F.create_map(*[x for k, v in params.items() for x in (F.lit(k), F.lit(str(v)))]).alias("params"),
        F.lit(json.dumps(json.loads(train.select(text_col).schema.json()))).alias("schema_json"),
    )
    ex = example.agg(F.collect_list(text_col).alias("input_example"))
    out = base.crossJoin(ex)
    return out.withColumn("run_name", run_name(F.lit(version), local_stamp(out, "started")))
