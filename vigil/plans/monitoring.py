"""Monitoring compositions: latest window, matched reference sample, window accuracy, drift.

The monitored system refreshes, every interval, the accuracy of the production model on
the latest ``window`` labelled rows and the embedding drift between those rows and an
equally large seeded sample of the training table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators import sampling
from vigil.operators.cumulative import settled
from vigil.operators.drift import embedding_drift
from vigil.operators.evaluation import accuracy

# The five monitoring gauge names of the monitored system.
METRIC_NAMES = ("model_accuracy", "drift_score", "semantic_drift_ks", "centroid_drift", "spread_drift")


def matched_reference_sample(ref: DataFrame, new: DataFrame, window: int = 200, seed: int = 42,
                             id_col: str = "review_id", ts_col: str = "ts") -> DataFrame:
    """A seeded sample of ``ref`` as large as the latest window of ``new``, with a status:
    'ok', or 'insufficient_reference' when ``ref`` has fewer rows (then all of it)."""
    n = sampling.latest(new.select(id_col, ts_col), ts_col, id_col, window).count()  # <= window
    sample = sampling.exact_sample(ref, id_col, n, seed)
    ref_n = ref.agg(F.count(F.lit(1)).alias("__ref_n"))
    return sample.crossJoin(F.broadcast(ref_n)).withColumn(
        "status", F.when(F.col("__ref_n") >= F.lit(n), "ok").otherwise("insufficient_reference")
    ).drop("__ref_n")


def window_accuracy(scored: DataFrame, window: int = 200, id_col: str = "review_id", ts_col: str = "ts",
                    label_col: str = "sentiment", pred_col: str = "prediction") -> DataFrame:
    """Accuracy over the latest window of scored rows; 0.0 with status 'no_data' when empty."""
    w = sampling.latest(scored.select(id_col, ts_col, label_col, pred_col), ts_col, id_col, window)
    return accuracy(w, label_col, pred_col)


def window_drift(ref_emb: DataFrame, new_emb: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Drift row between two embedded frames (each with ``vec_col``)."""
    both = ref_emb.select(F.col(vec_col).alias("embedding"), F.lit("ref").alias("grp")).unionByName(
        new_emb.select(F.col(vec_col).alias("embedding"), F.lit("new").alias("grp"))
    )
    return embedding_drift(settled(both))  # at most two windows of vectors: embedded once


def metrics_long(acc: DataFrame, drift: DataFrame) -> DataFrame:
    """Wide one-row metrics -> long (metric, value) rows with the gauge names."""
    wide = acc.select(F.col("accuracy").alias("model_accuracy")).crossJoin(
        drift.select(
            F.col("combined_drift_score").alias("drift_score"),
            F.col("semantic_ks").alias("semantic_drift_ks"),
            F.col("centroid_distance").alias("centroid_drift"),
            F.col("spread_distance").alias("spread_drift"),
        )
    )
    pairs = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in METRIC_NAMES)
    return wide.selectExpr(f"stack({len(METRIC_NAMES)}, {pairs}) AS (metric, value)")
