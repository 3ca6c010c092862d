"""Windowed metrics that lose no row: what comes behind the watermark goes to a table of its own.

A stateful aggregate drops late rows without a trace. `LateAwareWindows` is a ``foreachBatch`` body that keeps
tumbling event-time windows as mergeable parts (counts and sums, one row a window and batch) and, in the same commit, the
late rows themselves and one row of progress. So on time + late + undated = input, batch by batch, and a
replayed batch finds its key and adds nothing.

The watermark of a batch is the largest event time of the batches committed before it, less the delay. A row is late if its
window ended at or before that; a row without event time is undated. Nothing is held on the driver: the
watermark is a one-row aggregate of the progress table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.sources.commits import CommitLog
from vigil.streaming.jobs import batch_key


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_LONG, _TS = T.LongType(), T.TimestampNTZType()
PARTS = _struct(window_start=_TS, n=_LONG, n_right=_LONG, n_judged=_LONG, value_sum=T.DoubleType(), n_valued=_LONG)
PROGRESS = _struct(batch_id=_LONG, max_ts=_TS, n_in=_LONG, n_on_time=_LONG, n_late=_LONG, n_undated=_LONG)
SIDE = _struct(late_reason=T.StringType(), late_window=_TS, late_watermark=_TS)


class LateAwareWindows:
    """Per tumbling window: rows, accuracy and mean value of what came on time; the rest in `late_rows`.

    ``schema`` is that of the stream. Rows have no identity here: a stream that starts again with a fresh
    checkpoint cuts other batches and needs a fresh ``root``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, ts_col: str = "ts", label_col: str = "y",
                 pred_col: str = "yhat", value_col: str = "value", size: str = "1 hour", delay: str = "2 hours",
                 run_id: str = "windows"):
        self.ts_col, self.label_col, self.pred_col, self.value_col = ts_col, label_col, pred_col, value_col
        self.size, self.delay, self.run_id, self.columns = size, delay, run_id, schema.names
        clash = set(schema.names) & set(SIDE.names)
        if clash:
            raise ValueError(f"columns {sorted(clash)} are names of the side output")
        late = T.StructType([*schema.fields, *SIDE.fields])
        self.log = CommitLog(spark, root, {"parts": PARTS, "late": late, "progress": PROGRESS})

    def watermark(self) -> DataFrame:
        """One row: the watermark the next batch is judged by; null before the first."""
        newest = self.log.read("progress").agg(F.max("max_ts").alias("m"))
        return newest.select((F.col("m") - F.expr(f"INTERVAL {self.delay}")).alias("late_watermark"))

    def _judged(self, batch: DataFrame) -> DataFrame:
        """``batch`` with the columns of the side output; the reason is null for rows on time."""
        at = F.col(self.ts_col).cast("timestamp_ntz")
        none = F.lit(None)
        dated = batch.filter(at.isNotNull()).withColumn("__w", F.window(at, self.size)).crossJoin(F.broadcast(self.watermark()))
        ended = F.col("__w.end") <= F.col("late_watermark")
        side = dated.select(
            *self.columns, F.when(ended, "late").alias("late_reason"), F.col("__w.start").alias("late_window"), "late_watermark"
        )
        undated = batch.filter(at.isNull()).select(
            *self.columns, F.lit("undated").alias("late_reason"), none.cast("timestamp_ntz").alias("late_window"),
            none.cast("timestamp_ntz").alias("late_watermark"),
        )
        return side.unionByName(undated)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        key = batch_key(self.run_id, batch_id, batch)
        if self.log.has(key):
            return
        rows = self._judged(batch).persist()
        try:
            right = F.col(self.label_col) == F.col(self.pred_col)
            parts = rows.filter("late_reason IS NULL").groupBy(F.col("late_window").alias("window_start")).agg(
                F.count(F.lit(1)).alias("n"), F.count_if(right).alias("n_right"), F.count(right).alias("n_judged"),
                F.sum(F.col(self.value_col).cast("double")).alias("value_sum"), F.count(self.value_col).alias("n_valued"),
            )
            progress = rows.agg(
                F.max(F.col(self.ts_col).cast("timestamp_ntz")).alias("max_ts"), F.count(F.lit(1)).alias("n_in"),
                F.count_if(F.col("late_reason").isNull()).alias("n_on_time"),
                F.count_if(F.col("late_reason") == "late").alias("n_late"),
                F.count_if(F.col("late_reason") == "undated").alias("n_undated"),
            ).withColumn("batch_id", F.lit(batch_id).cast("long"))
            staged = [self.log.stage("parts", parts), self.log.stage("late", rows.filter("late_reason IS NOT NULL")),
                      self.log.stage("progress", progress)]
            self.log.commit(key, staged)
        finally:
            rows.unpersist()

    def windows(self) -> DataFrame:
        """(window_start, n, accuracy, mean_value) of the rows on time."""
        total = {c: F.sum(c) for c in PARTS.names[1:]}
        ratio = lambda a, b: F.when(total[b] > 0, total[a] / total[b])
        return self.log.read("parts").groupBy("window_start").agg(
            total["n"].alias("n"), ratio("n_right", "n_judged").alias("accuracy"), ratio("value_sum", "n_valued").alias("mean_value")
        )

    def late_rows(self) -> DataFrame:
        """The rows that no window counts, whole, with reason, window and the watermark they missed."""
        return self.log.read("late")

    def progress(self) -> DataFrame:
        """A row a batch: rows in, on time, late, undated."""
        return self.log.read("progress")
