"""Two-sample Kolmogorov-Smirnov statistic: the largest gap between two empirical CDFs.

Both samples are stacked, collapsed per distinct value (partial aggregation map-side),
and the running counts come from the bucketed running-total primitive. The statistic is
``max |F_a(v) - F_b(v)|`` over the distinct values; the p-value is not produced (the
monitoring job discards it). Nulls (and NaN) are not part of either sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.cumulative import running_totals, settled


def ks_two_sample(a: DataFrame, b: DataFrame, col: str = "v", num_buckets: int | None = None) -> DataFrame:
    """One row: ks_stat DOUBLE, n_a BIGINT, n_b BIGINT, status STRING ('ok' | 'no_data')."""
    v = F.col(col).cast("double")
    stacked = a.select(v.alias("v"), F.lit(True).alias("is_a")).unionByName(
        b.select(v.alias("v"), F.lit(False).alias("is_a"))
    )
    return ks_by_flag(stacked, "v", "is_a", num_buckets)


def ks_by_flag(df: DataFrame, value_col: str, flag_col, num_buckets: int | None = None) -> DataFrame:
    """KS between the rows where ``flag_col`` is true and where it is false (one scan);
    rows with a null flag belong to neither sample."""
    v = F.col(value_col).cast("double")
    flag = F.col(flag_col) if isinstance(flag_col, str) else flag_col
    rows = df.select(v.alias("v"), flag.alias("f")).filter(
        F.col("v").isNotNull() & ~F.isnan("v") & F.col("f").isNotNull()
    )
    # counts by distinct value, written once: totals, bounds and running sums read them, not the source
    grouped = settled(rows.groupBy("v").agg(
        F.count_if(F.col("f")).alias("ca"), F.count_if(~F.col("f")).alias("cb")
    ))
    totals = grouped.agg(
        F.coalesce(F.sum("ca"), F.lit(0)).cast("long").alias("n_a"),
        F.coalesce(F.sum("cb"), F.lit(0)).cast("long").alias("n_b"),
    )
    cum = running_totals(grouped, "v", ["ca", "cb"], num_buckets=num_buckets, materialize=False)
    # totals is a single row (a global aggregate): broadcast is bounded.
    both = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    gap = cum.crossJoin(F.broadcast(totals)).select(
        F.when(both, F.abs(F.col("cum_ca") / F.col("n_a") - F.col("cum_cb") / F.col("n_b"))).alias("gap")
    )
    stat = gap.agg(F.max("gap").alias("gap"))
    ok = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    return totals.crossJoin(stat).select(
        F.when(ok, F.col("gap")).otherwise(F.lit(0.0)).alias("ks_stat"),
        "n_a",
        "n_b",
        F.when(ok, F.lit("ok")).otherwise(F.lit("no_data")).alias("status"),
    )
