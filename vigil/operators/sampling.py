"""Seeded, exact-size sampling and splitting; anti join by row identity; hold-back.

NumPy's permutation cannot be reproduced on a cluster, so the contract is kept instead:
exact size, seeded, without replacement, disjoint and complete. The order is the md5 of
``"<seed>:<id>"`` with the id as tie-break; rows without an id come last, rows that repeat an
id count one by one. Split, sample, complement and hold-back are one rank cut over the
rows (`rank_cut`), the same at every size: the key that ends the cut is found over the ids alone,
then one narrow pass compares rows with it. Nothing here sorts the whole table or routes it through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.cumulative import rank_cut

KEY = "__sample_key"


def sample_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(id_col).cast("string")))


def exact_split(df: DataFrame, id_col: str, test_fraction: float = 0.2, seed: int = 42, out_col: str = "split") -> DataFrame:
    """Add ``split`` = 'test' for exactly ceil(test_fraction * n) rows, else 'train'."""
    if not 0.0 < test_fraction < 1.0:
        raise ValueError("test_fraction must lie strictly between 0 and 1")
    keyed = df.withColumn(KEY, sample_key(id_col, seed))
    flagged = rank_cut(keyed, KEY, id_col, F.ceil(F.lit(test_fraction) * F.col("__total")), "__in")
    return flagged.withColumn(out_col, F.when(F.col("__in"), "test").otherwise("train")).drop("__in", KEY)


def approximate_split(df: DataFrame, id_col: str, test_fraction: float = 0.2, seed: int = 42, out_col: str = "split") -> DataFrame:
    """One narrow pass: a row is 'test' when its hash falls below the fraction (size not exact)."""
    u = F.conv(F.substring(sample_key(id_col, seed), 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
    return df.withColumn(out_col, F.when(u < test_fraction, "test").otherwise("train"))


def _sampled(df: DataFrame, id_col: str, n: int, seed: int, flag_col: str) -> DataFrame:
    """``df`` with a flag on exactly min(n, count) rows, the first by the seeded order."""
    if n < 0:
        raise ValueError("n must be >= 0")
    keyed = df.withColumn(KEY, sample_key(id_col, seed))
    return rank_cut(keyed, KEY, id_col, F.least(F.lit(n), F.col("__total")), flag_col).drop(KEY)


def exact_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, count) rows, seeded, without replacement."""
    return _sampled(df, id_col, n, seed, "__in").filter("__in").drop("__in")


def anti_join_by_id(df: DataFrame, other: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose identity is not in ``other`` (identity, not value, equality)."""
    return df.join(other.select(id_col).distinct(), id_col, "left_anti")


def sample_complement(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """The table minus its exact sample of n rows: with the sample, every row once."""
    return _sampled(df, id_col, n, seed, "__in").filter("NOT __in").drop("__in")


def latest(df: DataFrame, ts_col: str, id_col: str, n: int) -> DataFrame:
    """The latest n rows by time; ties on time broken by the larger id. ``n`` is a window: each
    task keeps its own top n and one task merges them."""
    return df.orderBy(F.col(ts_col).desc_nulls_last(), F.col(id_col).desc()).limit(n)


def holdback(
    df: DataFrame,
    id_col: str,
    ts_col: str,
    window: int = 200,
    mode: str = "random",
    seed: int = 42,
    out_col: str = "action",
) -> DataFrame:
    """Split the monitoring table: ``window`` rows stay ('keep'), the rest go to training
    ('append'); with at most ``window`` rows everything stays. ``mode='random'`` keeps a
    seeded sample, ``mode='latest'`` keeps the newest rows. Every row comes back once. In
    'latest', rows that share time and id stay together, also where the window ends."""
    if mode == "random":
        marked = _sampled(df, id_col, window, seed, "__keep")
    elif mode == "latest":
        order = F.struct(F.col(ts_col).isNotNull().alias("dated"), F.col(ts_col).alias("ts"), F.col(id_col).alias("id"))
        newest = latest(df.select(id_col, ts_col), ts_col, id_col, window)
        oldest_kept = newest.agg(F.min(order).alias("__cut"))  # one row
        marked = df.crossJoin(F.broadcast(oldest_kept)).withColumn("__keep", order >= F.col("__cut")).drop("__cut")
    else:
        raise ValueError("mode must be 'random' or 'latest'")
    return marked.withColumn(out_col, F.when(F.col("__keep"), "keep").otherwise("append")).drop("__keep")


def example_pool(df: DataFrame, id_col: str, text_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Up to k random non-null examples (all of them when fewer exist)."""
    return exact_sample(df.dropna(subset=[text_col]), id_col, k, seed)
