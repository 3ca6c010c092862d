"""Commits over several tables, the resumable refresh, retraining that commits, scores that follow promotions."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from datasets import SF_SMALL
from vigil.plans import lineage, retrain, training
from vigil.session import scratch_path
from vigil.sources import tables
from vigil.sources.commits import REPLACE, CommitLog
from vigil.sources.io import REVIEWS
from vigil.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def reviews(spark, ids, word="text", ts=True):
    rows = [(i, f"{word} number {i}", i % 2, T0 + dt.timedelta(minutes=i // 3) if ts else None) for i in ids]
    return spark.createDataFrame(rows, REVIEWS)


def broken(df):
    return df.withColumn("review", F.when(F.raise_error(F.lit("the job dies here")).isNull(), "x"))


def test_commit_is_all_or_nothing_and_keys_count_once(spark):
    log = CommitLog(spark, scratch_path(spark, "log"), {"a": REVIEWS, "b": REVIEWS})
    assert log.read("a").count() == 0 and log.version() == 0 and not log.has("one")
    assert log.put("one", append={"a": reviews(spark, range(3)), "b": reviews(spark, range(5))})
    assert not log.put("one", append={"a": reviews(spark, range(3))})  # the same key again
    before = rows_of(log.read("a")), rows_of(log.read("b"))
    with pytest.raises(Exception, match="dies here"):  # one table is written, then the job dies
        log.put("two", append={"a": reviews(spark, range(9)), "b": broken(reviews(spark, range(2)))})
    assert (rows_of(log.read("a")), rows_of(log.read("b"))) == before and not log.has("two")
    assert log.put("two", append={"a": reviews(spark, [7])}, replace={"b": reviews(spark, [8])})
    assert [r.review_id for r in log.read("a").orderBy("review_id").collect()] == [0, 1, 2, 7]
    assert [r.review_id for r in log.read("b").collect()] == [8]
    again = CommitLog(spark, log.root, log.schemas)  # another process
    assert again.version() == 2 and rows_of(again.read("b")) == rows_of(log.read("b"))
    staged = log.stage("b", reviews(spark, range(4)), REPLACE)
    assert log.read("b").count() == 1 and log.staged_rows(staged).count() == 4  # not committed yet


def test_rows_are_taken_by_name_and_missing_columns_are_null(spark):
    log = CommitLog(spark, scratch_path(spark, "log"), {"a": REVIEWS})
    log.put("k", append={"a": spark.createDataFrame([("9", "x", 1)], "sentiment string, review string, extra int")})
    assert rows_of(log.read("a")) == [(None, "x", 9, None)]


# ---- refresh -----------------------------------------------------------------------------------

WINDOW = 20


@pytest.fixture(scope="module")
def feed(spark):
    """Four files whose rows interleave in time, ties and a repeated row included."""
    path = scratch_path(spark, "feed")
    every = reviews(spark, range(60)).unionByName(reviews(spark, [59]))
    for k in range(4):
        every.filter(F.col("review_id") % 4 == k).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return path


@pytest.fixture(scope="module")
def reference(spark):
    return reviews(spark, range(1000, 1060), "good", ts=False).drop("ts")


def run(spark, feed, refresher, checkpoint, files=1):
    stream = jobs.ingest(spark, feed, REVIEWS, max_files_per_trigger=files)
    q = jobs.refresh_stream(stream, refresher, checkpoint, available_now=True)
    q.awaitTermination()
    if q.exception():
        raise q.exception()


@pytest.fixture(scope="module")
def batch_result(spark, feed, reference):
    """Window and gauges of one batch over everything."""
    r = jobs.MetricsRefresher(spark, reference, scratch_path(spark, "monitor"), WINDOW)
    r(spark.read.parquet(feed), 0)
    return rows_of(r.window_rows()), last_gauges(r)


def last_gauges(r):
    newest = r.history().orderBy(F.desc("ts")).limit(5)
    return sorted((x.metric, round(x.value, 9), x.status) for x in newest.collect())


def test_stream_restart_replay_and_fresh_checkpoint_equal_the_batch(spark, feed, reference, batch_result):
    expected = rows_of(reviews(spark, range(40, 60)).select("review_id", "review", "sentiment", "ts"))
    assert batch_result[0] == expected
    root = scratch_path(spark, "monitor")
    died = []

    class Dies(jobs.MetricsRefresher):
        """Dies in its second batch, after the window was staged."""

        def _drift(self, window, n):
            died.append(n)
            if len(died) == 2:
                raise RuntimeError("executor lost")
            return super()._drift(window, n)

    with pytest.raises(Exception, match="executor lost"):
        run(spark, feed, Dies(spark, reference, root, WINDOW), f"{root}/checkpoint")
    r = jobs.MetricsRefresher(spark, reference, root, WINDOW)
    assert r.history().count() == 5  # one batch of four was committed
    run(spark, feed, r, f"{root}/checkpoint")  # a restart from the stream's checkpoint
    assert (rows_of(r.window_rows()), last_gauges(r)) == batch_result and r.history().count() == 20
    r(spark.read.parquet(feed), 9)
    r(spark.read.parquet(feed), 9)  # a replayed batch
    assert (rows_of(r.window_rows()), last_gauges(r)) == batch_result and r.history().count() == 25
    fresh = jobs.MetricsRefresher(spark, reference, root, WINDOW)
    run(spark, feed, fresh, f"{root}/fresh-checkpoint", files=3)  # all rows come again, under old batch numbers
    assert (rows_of(fresh.window_rows()), last_gauges(fresh)) == batch_result


def test_every_gauge_says_why_it_is_zero(spark, reference):
    root = scratch_path(spark, "monitor")
    none = jobs.MetricsRefresher(spark, reference, root, WINDOW)
    none(reviews(spark, []), 0)
    assert {(g[1], g[2]) for g in last_gauges(none)} == {(0.0, "no_data")}
    none(reviews(spark, range(5)), 1)
    said = {m: s for m, _, s in last_gauges(none)}
    assert said.pop("model_accuracy") == "no_model" and set(said.values()) == {"ok"}
    small = jobs.MetricsRefresher(spark, reference.limit(3), scratch_path(spark, "monitor"), WINDOW)
    small(reviews(spark, range(30)), 0)
    said = {m: (v, s) for m, v, s in last_gauges(small)}
    assert said["drift_score"] == (0.0, "insufficient_reference")


def test_reference_sample_follows_the_reference(spark, reference):
    state = {"v": 1}
    r = jobs.MetricsRefresher(spark, reference, scratch_path(spark, "monitor"), WINDOW, reference_version=lambda: state["v"])
    one = rows_of(r._reference_sample(10))
    r.reference = reviews(spark, range(2000, 2060), "other", ts=False).drop("ts")
    assert rows_of(r._reference_sample(10)) == one
    state["v"] = 2
    assert rows_of(r._reference_sample(10)) != one


# ---- retraining -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def seeded(spark):
    log = retrain.lineage_log(spark, scratch_path(spark, "lineage"))
    base = tables.lang_reviews(spark, SF_SMALL).limit(120)
    log.put("base", replace={"reviews": base})
    new = tables.lang_reviews(spark, SF_SMALL).limit(60).withColumn("ts", F.lit(None).cast("timestamp"))
    assert retrain.append_monitoring_batch(log, new, "batch-1", batch_ts="2024-05-01 10:00:00")
    assert not retrain.append_monitoring_batch(log, new, "batch-1", batch_ts="2024-05-01 10:00:00")
    assert log.read("new_reviews").filter("ts = timestamp '2024-05-01 10:00:00'").count() == 60
    return log


def test_fold_keeps_the_window_and_gives_disjoint_ids(spark, seeded):
    before = rows_of(seeded.read("reviews"))
    assert retrain.fold(seeded, "r1", window=20) and not retrain.fold(seeded, "r1", window=20)
    kept, folded = seeded.read("new_reviews"), seeded.read("reviews")
    assert kept.count() == 20 and folded.count() == 160
    assert folded.select("review_id").distinct().count() == 160  # the new rows had ids of the old ones
    assert set(before) <= set(rows_of(folded))
    texts = [r.review for r in folded.collect()] + [r.review for r in kept.collect()]
    assert len(texts) == 180
    nothing = retrain.fold(seeded, "r1b", window=50)  # at most the window: nothing moves
    assert nothing and seeded.read("new_reviews").count() == 20 and seeded.read("reviews").count() == 160


def test_a_crash_in_training_leaves_the_old_state(spark, seeded, monkeypatch):
    retrain.fold(seeded, "r2", window=20)
    real = lineage.run_metrics
    monkeypatch.setattr(lineage, "run_metrics", lambda *a, **k: broken(real(*a, **k).withColumn("review", F.lit(""))).withColumn("metric", F.col("review")))
    state = {t: rows_of(seeded.read(t)) for t in ("runs", "metric_history", "model_versions")}
    with pytest.raises(Exception, match="dies here"):
        retrain.train(seeded, "r2", gate=0.0, max_iter=5)
    assert {t: rows_of(seeded.read(t)) for t in state} == state
    monkeypatch.undo()
    out = retrain.retrain(seeded, "r2", window=20, gate=0.0, max_iter=5).first()  # the fold is not repeated
    assert out.registered and out.candidate_version == 1 and seeded.read("reviews").count() == 160
    names = {r.metric for r in seeded.read("metric_history").filter("run_id = 'r2'").collect()}
    assert names == {f"{p}_{m}" for p in ("test", "training") for m in lineage.RUN_METRICS}
    run = seeded.read("runs").filter("run_id = 'r2'").first()
    assert run.params["n_train"] == "128" and run.tags["algorithm"] == "logistic_regression" and len(run.input_example) == 5
    assert retrain.retrain(seeded, "r2", gate=0.0).first() == out and seeded.read("runs").count() == 1
    assert retrain.champion(seeded).count() == 0
    retrain.promote(seeded, 1)
    champion = retrain.champion(seeded).first()
    assert (champion.version, champion.run_id) == (1, "r2") and champion.accuracy == out.test_accuracy_score > 0
    below = retrain.retrain(seeded, "r3", window=20, gate=1.0, max_iter=5).first()
    assert not below.registered and below.candidate_version is None and seeded.read("model_versions").count() == 1


def test_a_promotion_changes_later_scores_only(spark):
    docs = tables.lang_reviews(spark, SF_SMALL).limit(90)
    log = retrain.lineage_log(spark, scratch_path(spark, "lineage"))
    for v, flipped in ((1, False), (2, True)):
        label = (1 - F.col("sentiment")) if flipped else F.col("sentiment")
        training.fit(docs.withColumn("sentiment", label), max_iter=5).model.write().save(f"{log.root}/models/{v}")
        row = spark.createDataFrame([(lineage.MODEL_NAME, v, f"r{v}", f"{log.root}/models/{v}")], "name string, version int, run_id string, path string")
        log.put(f"v{v}", append={"model_versions": row})
    cache = jobs.ModelCache(retrain.production(log))
    sink = jobs.ScoreSink(spark, scratch_path(spark, "scores"), cache, docs.schema)
    first, second = docs.filter("review_id % 2 = 0"), docs.filter("review_id % 2 = 1")
    with pytest.raises(RuntimeError, match="no model"):
        sink(first, 0)
    retrain.promote(log, 1)
    sink(first, 0)
    before = rows_of(sink.scores())
    retrain.promote(log, 2)
    sink(first, 0)  # replayed after the promotion: keeps its scores
    assert rows_of(sink.scores()) == before
    sink(second, 1)
    after = sink.scores()
    assert set(before) <= set(rows_of(after)) and after.count() == docs.count()
    assert {(r.review_id % 2, r.model_version) for r in after.collect()} == {(0, 1), (1, 2)}
