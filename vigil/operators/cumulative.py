"""Distributed running totals and exact rank cuts (never a global, unpartitioned window).

`running_totals` is the primitive behind the two-sample KS statistic, the ROC curve and
AUC. A window ordered over the whole table plans an ``Exchange SinglePartition``: every
row would pass through one task. Instead:

1. the caller collapses ties first (``groupBy(value)``), so duplicated values never pile
   up in one place, however skewed the data;
2. bucket bounds come from ``approxQuantile`` on the distinct values (a bounded list of
   ``num_buckets`` numbers), and ``Bucketizer`` (binary search, JVM side) maps every value
   to a bucket, monotonically;
3. per-bucket totals (at most ``num_buckets`` rows) get an exclusive prefix sum and are
   broadcast back -- a table whose size is bounded by the parameter, not by the data;
4. a window partitioned by bucket gives the running sum inside the bucket, plus the offset.

`rank_cut` marks the first ``n`` rows of a uniformly distributed string key (an md5 hex
digest) without ranking any row: histograms over hex prefixes of the key column alone close in on the
key that ends the cut (`cut_point`), and one narrow pass compares the rows with it.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

_BUCKET = "__bucket"


def default_buckets(df: DataFrame) -> int:
    """Several buckets per shuffle partition so that range tasks come out even."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(64, 4 * parts)


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder: what is read several times is computed once."""
    from vigil.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bucketize(df: DataFrame, order_col: str, num_buckets: int) -> tuple[DataFrame, int]:
    probs = [i / num_buckets for i in range(1, num_buckets)]
    bounds = df.approxQuantile(order_col, probs, 0.25 / num_buckets) if probs else []
    # infinite values fall into the outer buckets; without finite bounds (no rows) any one will do
    inner = sorted({float(b) for b in bounds if math.isfinite(b)}) or [0.0]
    splits = [float("-inf"), *inner, float("inf")]
    src = df.withColumn("__order_d", F.col(order_col).cast("double"))
    bucketed = Bucketizer(
        splits=splits, inputCol="__order_d", outputCol=_BUCKET, handleInvalid="keep"
    ).transform(src)
    return bucketed.drop("__order_d").withColumn(_BUCKET, F.col(_BUCKET).cast("int")), len(splits)


def running_totals(
    df: DataFrame,
    order_col: str,
    sum_cols: list[str],
    descending: bool = False,
    num_buckets: int | None = None,
    prefix: str = "cum_",
    next_cols: list[str] | None = None,
    materialize: bool = True,
) -> DataFrame:
    """Add ``prefix + c``: the inclusive running sum of ``c`` in ``order_col`` order.

    ``order_col`` must be numeric and distinct per row (group by it first). Null order
    values are not ranked and get null running sums. With ``next_cols``, also add
    ``next_<c>``: the value of ``c`` on the following row in that order (null on the last),
    found inside the bucket or, for a bucket's last row, from the first row of the next
    non-empty bucket (a bounded, broadcast table).

    With ``materialize`` the (already aggregated) input is checkpointed first, so the
    quantile pass and the main pass read it instead of recomputing its upstream shuffle.
    """
    num_buckets = num_buckets or default_buckets(df)
    if materialize:
        df = settled(df)
    bucketed, n_splits = _bucketize(df, order_col, num_buckets)
    if descending:
        # NaN ('keep' bucket = n_splits - 1) sorts last ascending and first descending.
        bucketed = bucketed.withColumn(_BUCKET, F.lit(n_splits - 1) - F.col(_BUCKET))

    totals = bucketed.groupBy(_BUCKET).agg(*[F.sum(c).alias(f"__tot_{c}") for c in sum_cols])
    before = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        _BUCKET,
        *[F.coalesce(F.sum(f"__tot_{c}").over(before), F.lit(0)).alias(f"__off_{c}") for c in sum_cols],
    )
    # `offsets` has at most num_buckets + 2 rows: a proven bound, so it is broadcast.
    joined = bucketed.join(F.broadcast(offsets), _BUCKET, "left")
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    within = Window.partitionBy(_BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = joined
    for c in sum_cols:
        out = out.withColumn(f"{prefix}{c}", F.sum(c).over(within) + F.col(f"__off_{c}"))
    if next_cols:
        ordered = Window.partitionBy(_BUCKET).orderBy(order)
        pick = F.max_by if descending else F.min_by
        firsts = bucketed.groupBy(_BUCKET).agg(
            pick(F.struct(*[F.col(c) for c in next_cols]), F.col(order_col)).alias("__first")
        )
        following = Window.orderBy(_BUCKET)
        # at most num_buckets + 2 rows: bounded, broadcast
        nxt = firsts.select(_BUCKET, F.lead("__first").over(following).alias("__next_first"))
        out = out.join(F.broadcast(nxt), _BUCKET, "left")
        for c in next_cols:
            out = out.withColumn(f"next_{c}", F.coalesce(F.lead(c).over(ordered), F.col(f"__next_first.{c}")))
        out = out.drop("__next_first")
    return out.drop(_BUCKET, *[f"__off_{c}" for c in sum_cols])


_KEY, _TIE, _CNT = "__k", "__t", "__cnt"


def _holding(groups: DataFrame, order: list, n: F.Column) -> DataFrame:
    """Of ``groups`` (with counts) in ``order`` the one that holds place ``n``: one row at most, with the
    rows ``__before`` it."""
    place = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    upto = groups.withColumn("__upto", F.sum(_CNT).over(place))
    return upto.filter((F.col("__upto") - F.col(_CNT) < n) & (n <= F.col("__upto"))).withColumn(
        "__before", F.col("__upto") - F.col(_CNT)
    )


def cut_point(df: DataFrame, key_col: str, tie_col: str, n_expr: F.Column, prefix_digits: int = 4) -> DataFrame:
    """Where the first ``n`` rows in ``(key_col, tie_col)`` order end: ``__k``, ``__t`` of the last one, ``__cnt`` rows that
    share both, ``__take`` of them within the cut. One row, or none when ``n`` is 0 or there are no rows.

    A histogram over hex prefixes finds the prefix that holds the cut, one over the prefixes twice as long within
    it narrows it down to about 1 / 16**(2 * prefix_digits) of the keys, and only those are compared whole, as groups of equal rows with counts.
    Just the two columns are read; a hot key is a count in every step."""
    keys = df.select(F.col(key_col).alias(_KEY), F.col(tie_col).alias(_TIE))
    digits = lambda at: F.substring(_KEY, at, prefix_digits)
    coarse = keys.groupBy(digits(1).alias("__p1")).agg(F.count(F.lit(1)).alias(_CNT))
    # one row; keys that are null come last, as they do in every step below
    wanted = coarse.agg(F.sum(_CNT).alias("__total")).select(F.least(n_expr.cast("long"), F.col("__total")).alias("__n"))
    # at most 16**prefix_digits + 1 groups each
    first = _holding(coarse.crossJoin(F.broadcast(wanted)), [F.col("__p1").asc_nulls_last()], F.col("__n")).select(
        "__p1", (F.col("__n") - F.col("__before")).alias("__left")
    )
    narrowed = keys.join(F.broadcast(first), digits(1).eqNullSafe(F.col("__p1")))
    second = _holding(
        narrowed.groupBy("__p1", digits(prefix_digits + 1).alias("__p2"), "__left").agg(F.count(F.lit(1)).alias(_CNT)),
        [F.col("__p2").asc_nulls_last()], F.col("__left"),
    ).select(F.col("__p1").alias("__q1"), F.col("__p2").alias("__q2"), (F.col("__left") - F.col("__before")).alias("__left"))
    here = digits(1).eqNullSafe(F.col("__q1")) & digits(prefix_digits + 1).eqNullSafe(F.col("__q2"))
    same = keys.join(F.broadcast(second), here).groupBy(_KEY, _TIE, "__left").agg(F.count(F.lit(1)).alias(_CNT))
    last = _holding(same, [F.col(_KEY).asc_nulls_last(), F.col(_TIE).asc_nulls_first()], F.col("__left"))
    return last.select(_KEY, _TIE, _CNT, (F.col("__left") - F.col("__before")).alias("__take"))


def rank_cut(
    df: DataFrame,
    key_col: str,
    tie_col: str,
    n_expr: F.Column,
    flag_col: str = "in_cut",
    prefix_digits: int = 4,
) -> DataFrame:
    """Flag the first ``n`` rows in ``(key_col, tie_col)`` order; ``key_col`` is hex text.

    ``n_expr`` may refer to ``__total`` (the row count), e.g. ``ceil(0.2 * __total)``. Every row
    comes back once: rows without a key are last in the order, rows of one key and tie are
    told apart by their place in a written copy.

    The cut is found over the two columns alone (`cut_point`, one row to the driver); the rows themselves are
    then compared with it in one narrow pass. Only if the cut falls between rows that share key and tie are these
    written and numbered.
    """
    cut = cut_point(df, key_col, tie_col, n_expr, prefix_digits).first()
    if cut is None:
        return df.withColumn(flag_col, F.lit(False))
    key, tie = F.col(key_col), F.col(tie_col)
    last_key = F.lit(cut[_KEY]).cast(df.schema[key_col].dataType)
    last_tie = F.lit(cut[_TIE]).cast(df.schema[tie_col].dataType)
    same_key = key.eqNullSafe(last_key)
    equal = same_key & tie.eqNullSafe(last_tie)
    # nulls: keys last, ties first
    before_key = F.coalesce(key < last_key, key.isNotNull() & last_key.isNull())
    before_tie = F.coalesce(tie < last_tie, tie.isNull() & last_tie.isNotNull())
    before = before_key | (same_key & before_tie)
    if cut["__take"] == cut[_CNT]:
        return df.withColumn(flag_col, before | equal)
    # Copies of one row may be any share of the table: the distributed row numbering tells them apart. Their place in a
    # checkpointed copy is the order, so that they are numbered the same way on every recompute.
    from vigil.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    copies = df.filter(equal).checkpoint(eager=True).withColumn("__pos", F.monotonically_increasing_id())
    numbered = row_sequence(copies, ["__pos"], "__rank")
    some = numbered.withColumn(flag_col, F.col("__rank") <= F.lit(cut["__take"])).drop("__pos", "__rank")
    return df.filter(~equal).withColumn(flag_col, before).unionByName(some)


def row_sequence(df: DataFrame, order_cols: list, out_col: str = "seq") -> DataFrame:
    """Number rows 1..n in ``order_cols`` order (which must be unique per row) without a
    global window.

    The table is range-partitioned and sorted (balanced, because the keys are unique),
    written to the checkpoint folder so the partition layout is fixed, and each row's
    number is its partition's offset (prefix sum of per-partition counts, one row per
    partition: bounded and broadcast) plus its position inside the partition.
    """
    from vigil.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    sorted_df = df.orderBy(*order_cols).checkpoint(eager=True)
    pid = F.spark_partition_id()
    tagged = sorted_df.withColumn("__pid", pid).withColumn(
        "__pos", F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)
    )
    sizes = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return tagged.join(F.broadcast(offsets), "__pid").withColumn(
        out_col, (F.col("__off") + F.col("__pos") + F.lit(1)).cast("long")
    ).drop("__pid", "__pos", "__off")
