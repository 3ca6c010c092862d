import math

import pytest
from pyspark.sql import functions as F

from vigil.operators import drift
from vigil.operators import evaluation as ev


def frame(spark, y, p1=None, yhat=None):
    rows = [(i, y[i], (yhat[i] if yhat else None), (p1[i] if p1 else None)) for i in range(len(y))]
    return spark.createDataFrame(rows, "id long, y int, yhat int, p1 double")


def test_auc_ties_across_classes(spark):
    df = frame(spark, [1, 1, 0, 0], p1=[0.9, 0.4, 0.4, 0.1])
    r = ev.roc_auc(df, num_buckets=2).first()
    assert r.roc_auc == pytest.approx(0.875)
    pts = sorted((r.fpr, r.tpr) for r in ev.roc_curve(df, num_buckets=2).collect())
    assert pts == [(0.0, 0.0), (0.0, 0.5), (0.5, 1.0), (1.0, 1.0)]


def test_auc_single_class_is_null(spark):
    assert ev.roc_auc(frame(spark, [1, 1], p1=[0.2, 0.3])).first().roc_auc is None


def test_auc_complement(spark):
    y = [1, 0, 1, 1, 0, 0, 1, 0, 1, 1]
    p = [0.9, 0.8, 0.7, 0.7, 0.3, 0.2, 0.65, 0.65, 0.1, 0.5]
    a = ev.roc_auc(frame(spark, y, p1=p), num_buckets=3).first().roc_auc
    b = ev.roc_auc(frame(spark, y, p1=[1 - x for x in p]), num_buckets=3).first().roc_auc
    assert a + b == pytest.approx(1.0)


def test_class_never_predicted(spark):
    df = frame(spark, [0, 1, 1, 0], yhat=[1, 1, 1, 1])
    rep = {r.label: r for r in ev.classification_report(df).collect()}
    assert rep["Negative"].precision == 0.0 and rep["Negative"].f1_score == 0.0
    assert rep["Positive"].precision == 0.5 and rep["Positive"].recall == 1.0
    assert rep["accuracy"].f1_score == 0.5 and rep["accuracy"].support == 4
    macro = ev.macro_prf(df).first()
    assert macro.precision_macro == pytest.approx((0.0 + 0.5) / 2)
    cm = {(r.y_true, r.y_pred): r.n for r in ev.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 0, (0, 1): 2, (1, 0): 0, (1, 1): 2}


def test_log_loss_finite_at_extremes(spark):
    r = ev.log_loss(frame(spark, [1, 0, 1], p1=[1.0, 0.0, 0.0])).first().log_loss
    assert math.isfinite(r) and r > 10


def test_accuracy_empty(spark):
    r = ev.accuracy(frame(spark, [1], yhat=[1]).filter("false")).first()
    assert (r.accuracy, r.status) == (0.0, "no_data")


def emb(spark, ref, new):
    rows = [(v, "ref") for v in ref] + [(v, "new") for v in new]
    return spark.createDataFrame(rows, "embedding array<float>, grp string")


def test_drift_identical_sets_is_zero(spark):
    vecs = [[1.0, 0.0], [0.0, 1.0], [0.5, 0.5]]
    r = drift.embedding_drift(emb(spark, vecs, vecs)).first()
    assert (r.semantic_ks, r.centroid_distance, r.spread_distance, r.combined_drift_score) == (0.0, 0.0, 0.0, 0.0)


def test_drift_centroid_distance_is_clamped(spark):
    r = drift.embedding_drift(emb(spark, [[1.0, 0.0], [0.0, 1.0]], [[11.0, 0.0], [10.0, 1.0]])).first()
    assert r.centroid_distance == pytest.approx(10.0)
    assert r.combined_drift_score == pytest.approx(0.5 * r.semantic_ks + 0.3 * 1.0 + 0.2 * min(r.spread_distance / 5, 1))


def test_distances_of_unequal_widths_are_an_error(spark):
    for ref, new in (([[1.0, 2.0]], [[1.0, 2.0, 9.0]]), ([[1.0, 2.0, 9.0]], [[1.0, 2.0]])):
        moments = drift.dimension_moments(emb(spark, ref, new))
        for column in ("centroid_distance", "spread_distance"):
            with pytest.raises(Exception, match="unequal width"):
                drift.moment_distances(moments).select(column).collect()


def test_drift_empty_side_and_zero_vector(spark):
    r = drift.embedding_drift(emb(spark, [[1.0, 0.0]], [])).first()
    assert r.status == "no_data" and r.combined_drift_score == 0.0
    e = emb(spark, [[1.0, 0.0], [0.0, 1.0]], [[0.0, 0.0]])
    c = drift.group_vectors(drift.dimension_moments(e)).filter(F.col("grp") == "ref")
    sims = {r.grp: r.similarity for r in drift.similarity_to_centroid(e, c).collect() if r.grp == "new"}
    assert sims["new"] is None


def test_pandas_encoder_hook_feeds_drift(spark):
    from vigil.functions.encoders import pandas_encoder

    def toy_encoder():  # defined inline so that it ships to the workers by value
        import numpy as np

        def encode(texts):
            return np.array([[float(len(t)), float(t.count(" ")), 1.0] for t in texts])

        return encode

    enc = pandas_encoder(toy_encoder, batch_size=2)
    df = spark.createDataFrame([("a b", "ref"), ("ccc", "ref"), ("dd ee ff", "new"), ("g", "new")], "t string, grp string")
    out = df.withColumn("embedding", enc("t"))
    vecs = {r.t: r.embedding for r in out.collect()}
    assert vecs["a b"] == [3.0, 1.0, 1.0]
    r = drift.embedding_drift(out).first()
    assert r.status == "ok" and r.n_ref == 2 and r.n_new == 2


def test_preprocess_plugin_is_saved_with_model(spark):
    from vigil.plans import training

    rows = [(i, ("great stay lovely staff " if i % 2 else "awful noisy dirty room ") * 2, i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "review_id long, review string, sentiment int")
    fm = training.fit(df, preprocess_sql="upper({col})", max_features=50)
    # upper-cased text still tokenises; the SQL text travels inside the fitted stage
    assert "upper(coalesce(review, ''))" in fm.model.stages[0].getStatement()
    acc = training.score(fm.model, df).select(F.avg((F.col("prediction") == F.col("sentiment")).cast("double"))).first()[0]
    assert acc == 1.0


def test_roc_drop_intermediate_vs_brute_force(spark):
    import random

    rng = random.Random(5)
    y = [rng.randint(0, 1) for _ in range(400)]
    p = [rng.randint(0, 60) / 60 for _ in range(400)]
    df = frame(spark, y, p1=p)
    got = sorted((r.fpr, r.tpr) for r in ev.roc_curve(df, num_buckets=6).collect() if r.threshold is not None)
    scores = sorted(set(p), reverse=True)
    pos = [sum(1 for a, b in zip(y, p) if b == s and a == 1) for s in scores]
    neg = [sum(1 for a, b in zip(y, p) if b == s and a != 1) for s in scores]
    P, N = sum(y), len(y) - sum(y)
    keep = [i for i in range(len(scores))
            if i == 0 or i == len(scores) - 1 or (pos[i + 1], neg[i + 1]) != (pos[i], neg[i])]
    expect = sorted((sum(neg[: i + 1]) / N, sum(pos[: i + 1]) / P) for i in keep)
    assert [tuple(round(v, 12) for v in t) for t in got] == [tuple(round(v, 12) for v in t) for t in expect]
    assert len(ev.roc_curve(df, drop_intermediate=False).collect()) == len(scores) + 1


def test_summarizer_moments_equal_explode(spark):
    from datasets import SF_SMALL
    from vigil.sources import tables

    e = tables.embeddings(spark, SF_SMALL)
    a = {(r.grp, r.pos): (r.mean, r.std) for r in drift.dimension_moments(e).collect()}
    b = {(r.grp, r.pos): (r.mean, r.std) for r in drift.dimension_moments(e, method="summarizer").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == pytest.approx(b[k][0], abs=1e-9) and a[k][1] == pytest.approx(b[k][1], abs=1e-9)
    x = drift.embedding_drift(e).first()
    y = drift.embedding_drift(e, moments_method="summarizer").first()
    assert x.combined_drift_score == pytest.approx(y.combined_drift_score, abs=1e-9)


def test_fit_drops_blank_reviews_and_scores_null_text(spark):
    from vigil.plans import training

    rows = [(i, ("lovely clean quiet room " if i % 2 else "rude staff dirty noisy room ") * 2, i % 2) for i in range(30)]
    rows += [(100, None, 1), (101, "   ", 0), (102, "", 1)]
    df = spark.createDataFrame(rows, "review_id long, review string, sentiment int")
    fm = training.fit(df, max_features=50)
    assert fm.params["dropped_rows"] == "3" and fm.n_train == 30
    scored = {r.review_id: r.prediction for r in training.score(fm.model, df).collect()}
    assert set(scored) >= {100, 101, 102}  # null / blank text still scores
