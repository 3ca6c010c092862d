import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from vigil.operators import sampling
from vigil.sources import io


@pytest.mark.parametrize("n,test_rows", [(4, 1), (5, 1), (6, 2), (101, 21)])
def test_exact_split_sizes(spark, n, test_rows):
    df = spark.range(n).withColumnRenamed("id", "rid")
    out = sampling.exact_split(df, "rid", 0.2, 42).collect()
    assert len(out) == n and len({r.rid for r in out}) == n  # complete, disjoint
    assert sum(r.split == "test" for r in out) == test_rows
    again = {r.rid for r in sampling.exact_split(df, "rid", 0.2, 42).collect() if r.split == "test"}
    assert again == {r.rid for r in out if r.split == "test"}  # seeded


def test_sample_and_complement_hold_every_row_once(spark):
    """Null and repeated ids included; a third of the rows share one id."""
    ids = [None] * 30 + [7] * 40 + list(range(100, 150))
    df = spark.createDataFrame(list(enumerate(ids)), "row int, rid long")
    split = sampling.exact_split(df, "rid", 0.2, 42).collect()
    assert sorted(r.row for r in split) == list(range(120)) and sum(r.split == "test" for r in split) == 24
    for n in (0, 50, 100, 200):
        sample = [r.row for r in sampling.exact_sample(df, "rid", n, 7).collect()]
        rest = [r.row for r in sampling.sample_complement(df, "rid", n, 7).collect()]
        assert len(sample) == min(n, 120) and sorted(sample + rest) == list(range(120))


@pytest.mark.parametrize("mode", ["random", "latest"])
def test_holdback_keeps_rows_of_repeated_ids_apart(spark, mode):
    df = _events(spark, 300).unionAll(_events(spark, 300))
    out = sampling.holdback(df, "rid", "ts", 200, mode, 42).collect()
    assert len(out) == 600 and sum(r.action == "keep" for r in out) == 200


def _events(spark, n, same_ts=False):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base if same_ts else base + dt.timedelta(seconds=i)) for i in range(n)]
    return spark.createDataFrame(rows, "rid long, ts timestamp")


@pytest.mark.parametrize("n,appended", [(200, 0), (201, 1), (350, 150)])
@pytest.mark.parametrize("mode", ["random", "latest"])
def test_holdback_counts(spark, n, appended, mode):
    out = sampling.holdback(_events(spark, n), "rid", "ts", 200, mode, 42).collect()
    assert sum(r.action == "append" for r in out) == appended
    assert sum(r.action == "keep" for r in out) == min(n, 200)


def test_holdback_latest_ties_are_stable(spark):
    a = sampling.holdback(_events(spark, 260, same_ts=True), "rid", "ts", 200, "latest").collect()
    b = sampling.holdback(_events(spark, 260, same_ts=True), "rid", "ts", 200, "latest").collect()
    keep = sorted(r.rid for r in a if r.action == "keep")
    assert keep == sorted(r.rid for r in b if r.action == "keep") == list(range(60, 260))


def test_example_pool_fewer_than_k(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, text string")
    assert sorted(r.id for r in sampling.example_pool(df, "id", "text", 5).collect()) == [1, 3]


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_csv_edge_cases(spark):
    d = tempfile.mkdtemp(prefix="vigil-csv-")
    _write(os.path.join(d, "a.csv"),
           'Review,Sentiment\n"good, really",1\n"she said ""fine""",0\n"line one\nline two",1\n"",0\n')
    rows = io.read_reviews_csv(spark, os.path.join(d, "a.csv")).orderBy("sentiment", "review").collect()
    texts = sorted((r.review or "") for r in rows)
    assert texts == sorted(["good, really", 'she said "fine"', "line one\nline two", ""])
    _write(os.path.join(d, "b.csv"), 'Timestamp,Review,Sentiment\n"2024-01-02 03:04:05","ok",1\n')
    b = io.read_reviews_csv(spark, os.path.join(d, "b.csv")).first()
    assert b.review == "ok" and b.sentiment == 1 and b.ts is not None
    _write(os.path.join(d, "c.csv"), "Review,Sentiment,Timestamp\n")
    assert io.read_reviews_csv(spark, os.path.join(d, "c.csv")).count() == 0
    assert io.read_reviews_csv(spark, os.path.join(d, "missing.csv")).count() == 0


def test_json_records_required_fields(spark):
    df = spark.createDataFrame(
        [(1, '[{"Review": "nice", "Sentiment": 1}, {"Review": "no label"}, {"Sentiment": 0}]'),
         (2, '{"Review": "single", "Sentiment": 0}'), (3, "not json")],
        "b int, payload string",
    )
    rows = io.parse_json_records(df, "payload", batch_ts="2024-01-01 00:00:00").collect()
    assert sorted((r.b, r.Review, r.Sentiment) for r in rows) == [(1, "nice", 1), (2, "single", 0)]


def test_fingerprint_order_insensitive(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "id long, t string")
    b = spark.createDataFrame([(2, "y"), (1, "x"), (2, "y")], "id long, t string")
    fa, fb = io.fingerprint(a, ["id", "t"], "t").first(), io.fingerprint(b.repartition(3), ["id", "t"], "t").first()
    assert fa == fb
    c = spark.createDataFrame([(1, "x")], "id long, t string")
    assert io.fingerprint(c, ["id", "t"], "t").first().digest_sum != fa.digest_sum


def test_append_by_name(spark):
    a = spark.createDataFrame([(1, "r", 1)], "review_id long, review string, sentiment int")
    b = spark.createDataFrame([(dt.datetime(2024, 1, 1), "s", 0, 2)], "ts timestamp, review string, sentiment int, review_id long")
    out = io.append_by_name(a, b).orderBy("review_id").collect()
    assert [(r.review_id, r.review, r.ts is None) for r in out] == [(1, "r", True), (2, "s", False)]


def test_snapshot_partition_and_sorted_write(spark):
    from vigil.session import scratch_path

    root = scratch_path(spark, "snapshots")
    a = spark.createDataFrame([(1, "x")], "id long, t string")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "id long, t string")
    io.write_snapshot(a, root, "2024-01-01-00-00-00")
    io.write_snapshot(b, root, "2024-01-02-00-00-00")
    io.write_snapshot(b, root, "2024-01-02-00-00-00")  # rewrite of one tag leaves the other
    snap = spark.read.parquet(root)
    pruned = snap.filter(F.col("snapshot") == "2024-01-02-00-00-00")
    assert sorted(r.id for r in pruned.collect()) == [2, 3]
    assert snap.count() == 3
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot" in plan  # pruned at listing time, not filtered after reading
    out = scratch_path(spark, "sorted")
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=(7 * i) % 50)) for i in range(50)]
    io.overwrite_table(spark.createDataFrame(rows, "id long, ts timestamp").coalesce(1), out, sort_by=["ts"])
    ts = [r.ts for r in spark.read.parquet(out).collect()]
    assert ts == sorted(ts)


def test_promote_moves_alias(spark):
    from vigil.plans import lineage

    e1 = lineage.promote(spark, 1, ts="2024-01-01 00:00:00")
    e2 = lineage.promote(spark, 3, ts="2024-01-02 00:00:00")
    cur = lineage.current_alias(e1.unionByName(e2)).first()
    assert (cur.alias, cur.version) == ("prod", 3)


def test_latest_takes_the_newest(spark):
    got = sorted(r.rid for r in sampling.latest(_events(spark, 900), "ts", "rid", 300).collect())
    assert got == list(range(600, 900))



def test_data_summary_nested_and_json(spark):
    import json

    from vigil.plans.summary import data_summary
    from vigil.session import scratch_path

    split = spark.createDataFrame(
        [(1, "good room", 1, "train"), (2, "bad  noisy room", 0, "train"), (3, "ok", 1, "test")],
        "review_id long, review string, sentiment int, split string",
    )
    perf = spark.createDataFrame([(0.9, 0.8, 0.7, 0.75, 0.95, 0.3)],
                                 "test_accuracy double, test_precision double, test_recall double, "
                                 "test_f1_score double, test_roc_auc double, test_log_loss double")
    row = data_summary(split, perf).first().asDict(recursive=True)
    assert row["dataset_info"]["total_samples"] == 3 and row["dataset_info"]["test_samples"] == 1
    assert row["class_distribution"]["train"] == {"negative (0)": 1, "positive (1)": 1}
    assert row["text_statistics"]["max_review_length_chars"] == 15
    assert row["text_statistics"]["avg_review_length_words"] == 2  # int(mean(2, 3, 1))
    out = scratch_path(spark, "summary")
    io.write_json_summary(data_summary(split, perf), out)
    back = spark.read.json(out)
    assert back.count() == 1
    assert json.loads(back.toJSON().first())["model_performance"]["test_roc_auc"] == 0.95
