"""The factorisation machine against the sum over all pairs, its inputs, and accuracy on held-out labels."""

import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import factors as M

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scores(spark):
    return {r.doc_id: r for r in M.op13_quality_classifier(spark, SF).collect()}


def test_linear_time_margin_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    n = M.BUCKETS + 3
    model = M.Machine(0.3, rng.normal(0, 1, n), rng.normal(0, 1, (n, M.RANK)), np.array([1.0, 2.0, 0.0]), np.array([2.0, 1.0, 1.0]))
    texts = ["a b c b", None, "one", "the the the cat sat on on a mat"]
    dense = rng.normal(0, 2, (4, 3))
    dense[1, 2] = np.nan
    words = [M.hashed_words(t) for t in texts]
    got = model.margin(M.Sparse.of(words), dense)
    for i, (bucket, value) in enumerate(words):
        x = {int(b): float(v) for b, v in zip(bucket, value)}
        x |= {M.BUCKETS + j: float(v) for j, v in enumerate(model.standard(dense[i:i + 1])[0])}
        margin = model.bias + sum(model.weight[k] * v for k, v in x.items())
        margin += sum(model.factor[a] @ model.factor[b] * x[a] * x[b] for a, b in combinations(x, 2))
        assert abs(margin - got[i]) < 1e-9


def test_pairs_matter_to_the_fit():
    """Exclusive or: no weight alone tells the classes, only the pair does."""
    rng = np.random.default_rng(3)
    dense = rng.choice([-1.0, 1.0], (600, 2))
    y = (dense[:, 0] * dense[:, 1] > 0).astype(float)
    words = M.Sparse.of([M.hashed_words("")] * 600)
    assert ((M.fit(words, dense, y).score(words, dense) > 0.5) == y).mean() > 0.97


def test_held_out_labels_are_predicted(spark, scores):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality IS NOT NULL").collect()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in scores.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scores.values())
    held = [(scores[r.doc_id], r.quality) for r in labels if scores[r.doc_id].held_out]
    assert np.mean([r.predicted == q for r, q in held]) > 0.97
    good, bad = [r.score for r, q in held if q], [r.score for r, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.99


def test_only_text_and_metadata_of_learnt_rows_count(spark, scores):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    full = {r.doc_id: r["__score"] for r in M.quality_scores(spark.read.parquet(f"{SF}/documents.parquet"), labels, ["n_chars"]).collect()}
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    model = M.fitted(spark.read.parquet(f"{SF}/documents.parquet"), other, ["n_chars"])
    moved = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 10**9})
    for r in M.scored(moved, model, ["n_chars"]).collect():
        assert r["__score"] == full[r.doc_id - 10**9] == scores[r.doc_id - 10**9].score


def test_edge_rows_and_no_rows(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (5, 0), (8, 1), (None, 1), (9, 7)], "doc_id long, quality int")
    got = M.quality_scores(edge, labels, ["n_chars"])
    assert got.columns == [*edge.columns, "__score", "__held_out"]
    rows = got.collect()
    assert len(rows) == edge.count() and all(0 <= r["__score"] <= 1 for r in rows)
    assert all(not r["__held_out"] for r in rows if r.doc_id is None)
    same = {r["__score"] for r in rows if r.doc_id == 4 and r.text.startswith("alpha")}
    assert len(same) == 1
    assert M.quality_scores(empty, labels, ["n_chars"]).count() == 0
    alone = M.quality_scores(edge, labels.filter("false")).collect()
    assert {r["__score"] for r in alone} == {0.5}
