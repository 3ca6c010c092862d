import random

import pytest
from pyspark.sql import functions as F

from vigil.operators.cumulative import rank_cut, row_sequence, running_totals
from vigil.operators.ks import ks_two_sample


def brute_ks(a, b):
    vals = sorted(set(a) | set(b))
    best = 0.0
    for v in vals:
        fa = sum(x <= v for x in a) / len(a)
        fb = sum(x <= v for x in b) / len(b)
        best = max(best, abs(fa - fb))
    return best


def ks(spark, a, b, buckets=None):
    da = spark.createDataFrame([(float(x),) for x in a], "v double")
    db = spark.createDataFrame([(float(x),) for x in b], "v double")
    return ks_two_sample(da, db, num_buckets=buckets).first()


@pytest.mark.parametrize(
    "a,b,expected",
    [([1, 2, 3], [1, 2, 3], 0.0), ([1, 2], [3, 4], 1.0), ([1, 1, 2], [1, 2, 2], 1 / 3)],
)
def test_ks_fixtures(spark, a, b, expected):
    r = ks(spark, a, b)
    assert r.ks_stat == pytest.approx(expected)
    assert r.status == "ok"


def test_ks_empty_side(spark):
    r = ks(spark, [1.0, 2.0], [])
    assert (r.ks_stat, r.status, r.n_b) == (0.0, "no_data", 0)


def test_ks_random_vs_brute_force(spark):
    rng = random.Random(7)
    for _ in range(3):
        a = [rng.randint(0, 30) / 3 for _ in range(rng.randint(5, 60))]
        b = [rng.randint(0, 40) / 3 for _ in range(rng.randint(5, 60))]
        r = ks(spark, a, b, buckets=5)
        assert r.ks_stat == pytest.approx(brute_ks(a, b))
        assert ks(spark, b, a, buckets=3).ks_stat == pytest.approx(r.ks_stat)  # symmetric
        assert 0.0 <= r.ks_stat <= 1.0


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_vs_brute_force(spark, descending):
    rng = random.Random(3)
    vals = rng.sample(range(-500, 500), 300)
    rows = [(float(v), rng.randint(0, 9)) for v in vals]
    df = spark.createDataFrame(rows, "v double, c long")
    out = {r.v: r.cum_c for r in running_totals(df, "v", ["c"], descending=descending, num_buckets=7).collect()}
    order = sorted(rows, reverse=descending)
    acc = 0
    for v, c in order:
        acc += c
        assert out[v] == acc


def test_running_totals_plan_is_partitioned(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("c"))
    plan = running_totals(df, "v", ["c"], num_buckets=16)._jdf.queryExecution().executedPlan().toString()
    # the data-sized window is partitioned by bucket; only the bounded bucket table is ranked alone
    assert "hashpartitioning(__bucket" in plan


def test_rank_cut_and_row_sequence(spark):
    rng = random.Random(11)
    ids = rng.sample(range(10_000), 500)
    df = spark.createDataFrame([(i,) for i in ids], "id long").withColumn("k", F.md5(F.col("id").cast("string")))
    flagged = rank_cut(df, "k", "id", F.lit(123), "in_cut", prefix_digits=2).collect()
    import hashlib

    expected = set(sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[:123])
    assert {r.id for r in flagged if r.in_cut} == expected
    assert len(flagged) == 500
    seq = row_sequence(df, ["k", "id"], "seq").collect()
    by_key = sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    assert sorted((r.seq, r.id) for r in seq) == [(n + 1, i) for n, i in enumerate(by_key)]


def test_exact_split_is_one_narrow_pass(spark):
    from vigil.operators.sampling import exact_split

    df = spark.range(5000).withColumnRenamed("id", "rid")
    plan = exact_split(df, "rid", 0.2, 42)._jdf.queryExecution().executedPlan().toString()
    # the cut is known before the rows are read: no shuffle, no window, no join, one scan
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan and plan.count("Range (") == 1


def test_the_cut_reads_ids_only(spark, tmp_path):
    from vigil.operators.cumulative import cut_point

    path = str(tmp_path / "wide")
    spark.range(100).select(F.md5(F.col("id").cast("string")).alias("k"), "id", F.lit("text").alias("wide")).write.parquet(path)
    plan = cut_point(spark.read.parquet(path), "k", "id", F.lit(7))._jdf.queryExecution().executedPlan().toString()
    assert "wide" not in plan.replace(path, "")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 57, 199, 200, 201, 260, 300, 301, 900])
def test_rank_cut_over_nulls_and_copies(spark, n):
    """Of 200 distinct ids, 100 rows without one, and copies: every cut is exact and keeps to the order."""
    import hashlib

    ids = list(range(100)) + [7] * 100 + [None] * 100
    df = spark.createDataFrame([(i,) for i in ids], "id long").withColumn("k", F.md5(F.col("id").cast("string")))
    order = sorted(ids, key=lambda i: (i is None, "" if i is None else hashlib.md5(str(i).encode()).hexdigest()))
    rows = rank_cut(df, "k", "id", F.lit(n), prefix_digits=1).collect()
    key = lambda v: (v is None, v or 0)
    assert sorted((r.id for r in rows if r.in_cut), key=key) == sorted(order[:n], key=key)
    assert sorted((r.id for r in rows), key=key) == sorted(ids, key=key)


def test_hot_value_holding_a_third_of_rows(spark):
    """One value holds a third of the rows: it collapses to one grouped row before any
    ordering, and the distinct values spread evenly over the buckets."""
    n = 30_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7.5)).otherwise(F.col("id").cast("double") / 10).alias("v"),
        (F.col("id") % 2 == 0).alias("is_a"),
    )
    from vigil.operators.ks import ks_by_flag

    r = ks_by_flag(df, "v", "is_a", num_buckets=16).first()
    rows = df.collect()
    a = [x.v for x in rows if x.is_a]
    b = [x.v for x in rows if not x.is_a]
    import bisect

    sa, sb = sorted(a), sorted(b)
    best = max(abs(bisect.bisect_right(sa, v) / len(sa) - bisect.bisect_right(sb, v) / len(sb)) for v in set(sa) | set(sb))
    assert r.ks_stat == pytest.approx(best)
    grouped = df.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    from vigil.operators.cumulative import _bucketize

    bucketed, _ = _bucketize(grouped, "v", 16)
    sizes = [x["count"] for x in bucketed.groupBy("__bucket").count().collect()]
    assert max(sizes) < 3 * (len(set(sa) | set(sb)) / 16)  # balanced on distinct values


def test_rank_cut_with_copies_of_one_key(spark):
    """A third of the rows are copies of one id: the cut is still exact."""
    from vigil.operators.sampling import exact_split

    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("rid"))
    out = exact_split(df, "rid", 0.2, 42).collect()
    assert len(out) == 3000 and sum(r.split == "test" for r in out) == 600


def test_ks_and_roc_without_rows_and_with_infinities(spark):
    from vigil.operators import evaluation, ks

    none = spark.createDataFrame([], "v double, f boolean")
    row = ks.ks_by_flag(none, "v", "f").first()
    assert (row.ks_stat, row.status) == (0.0, "no_data")
    inf = float("inf")
    rows = spark.createDataFrame([(-inf, True), (inf, True), (inf, False), (0.0, False)], "v double, f boolean")
    assert ks.ks_by_flag(rows, "v", "f").first().ks_stat == 0.5
    scored = spark.createDataFrame([(1, inf), (0, -inf), (1, inf), (0, 0.0)], "y int, p1 double")
    assert evaluation.roc_auc(scored).first().roc_auc == 1.0


def test_log_loss_leaves_out_rows_without_label_or_score(spark):
    import math

    from vigil.operators import evaluation

    rows = spark.createDataFrame([(1, 0.5), (1, None), (None, 0.9)], "y int, p1 double")
    assert abs(evaluation.log_loss(rows).first().log_loss - math.log(2)) < 1e-12


def test_dot_of_unequal_widths_is_an_error(spark):
    import pytest
    from pyspark.sql import functions as F

    from vigil.functions import vectors

    rows = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0, 3.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="unequal width"):
        rows.select(vectors.dot("a", "b").alias("d")).collect()
    null = spark.createDataFrame([([1.0, None], [1.0, 2.0])], "a array<double>, b array<double>")
    assert null.select(vectors.dot("a", "b").alias("d")).first().d is None
