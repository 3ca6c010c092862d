"""Hard negatives against a comparison of all rows, on edge rows and small limits."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import negatives as N

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every=100):
    used = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        used.append((vec_id, [math.floor(256 * x) for x in vector], label))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    def ids(r):
        return (r[0] is None, r[0] or 0)

    out = []
    for i, (anchor, a, label) in enumerate(used):
        if anchor is None or anchor % every:
            continue
        others = [(score(a, v), vec_id, own) for j, (vec_id, v, own) in enumerate(used) if j != i]
        order = sorted(others, key=lambda r: (-r[0], ids(r[1:])))
        for p, positive, _ in [r for r in order if r[2] == label][:5]:
            fit = [r for r in order if r[2] != label and 30 * p <= 100 * r[0] <= 90 * p][:10]
            out += [(anchor, positive, k, r[1], p, r[0]) for k, r in enumerate(fit, 1)]
    return sorted(out, key=repr)


def mined(df, **kw):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted([tuple(r) for r in N.hard_negatives(df, **kw).select(columns).collect()], key=repr)


def random_rows(n, d, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, (4, d))
    return [(i, (centre[i % 4] * (i % 3 > 0) + rng.normal(0, spread, d)).tolist(), int(rng.integers(0, 3))) for i in range(n)]


EDGE = [
    (None, [0.5, 0.25], 1), (0, None, 1), (0, [0.1, None], 1), (0, [0.1, float("nan")], 1), (0, [float("inf"), 1.0], 1), (0, [1.0, 1.0], None),
    (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (3, [0.5, 0.5], 2), (5, [0.5, 0.5], 2), (4, [0.5, 0.5], 2), (9, [], 1), (10, [0.0, 0.0], 1),
    (200, [0.0, 0.0], 3), (100, [1.0, 0.5, 4.0], 2), (300, [-1.0, -0.5], 1), (11, [0.7], 3), *[(50 + i, [0.25, 0.5], i % 2) for i in range(30)],
]


@pytest.mark.parametrize("rows", [EDGE, random_rows(300, 5, 1), random_rows(200, 3, 2, 0.01)], ids=["edge", "random", "tight"])
def test_equals_comparison_of_all_rows(spark, monkeypatch, rows):
    monkeypatch.setattr(N, "PACK_OCTETS", 600)
    monkeypatch.setattr(N, "STRIDE", 8)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    clash = df.withColumns({c: F.lit("x") for c in ("row", "pack", "anchor", "slot", "vector", "cluster", "extra", "rank", "best")})
    assert mined(clash, anchor_every=20) == plain(rows, 20)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i), float(3 * i - 2**21) + 0.5], i % 2) for i in range(40)]  # products beyond 2^53
    assert mined(spark.createDataFrame(rows, SCHEMA), anchor_every=10) == plain(rows, 10)
    with pytest.raises(Exception, match="64"):
        mined(spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1)], SCHEMA))


def test_walks_end_early_where_angles_are_small(spark, monkeypatch):
    """On tight groups of vectors a walk reads a small part of the list, and finds the same."""
    rows = random_rows(2000, 6, 3, 0.002)
    vectors = N.whole_numbers([v for _, v, _ in rows])
    numbers = [np.array([r[c] for r in rows], np.int64) for c in (0, 2)]
    block = N.Pack(np.arange(2000), numbers[0], np.zeros(2000, np.int64), np.zeros((2000, 1), np.int64), vectors)
    chunk = block.take(np.arange(1, 2000, 400))
    chunk.extra = np.arange(len(chunk))[:, None]  # a cluster each
    read = 0
    for cluster in N.clusters_of(chunk):
        counted = []
        best = N.Best(len(cluster.members), 5)
        monkeypatch.setattr(N, "STRIDE", 50)
        real = N._first
        monkeypatch.setattr(N, "_first", lambda hit, score, k: counted.append(score.shape[1]) or real(hit, score, k))
        N.walk(best, chunk, cluster, block, np.arange(2000), vectors.astype(float) @ cluster.direction, N.comparable(chunk, block), None)
        monkeypatch.setattr(N, "_first", real)
        read += sum(counted)
        own = chunk.row[cluster.members[0]]
        every = vectors @ vectors[own]
        expected = [i for i in np.lexsort((np.arange(2000), -every)) if i != own][:5]
        assert best.found[:, 3].tolist() == expected
    assert read < 2000 * len(chunk) / 2


def test_query_equals_sql(spark):
    got = sorted(tuple(r) for r in N.op12_hard_negatives(spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    rows = con.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({N.ORACLE_SQL})").fetchall()
    assert got == sorted(rows) and got


def test_no_rows(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)) == []
