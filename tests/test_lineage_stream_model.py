import datetime as dt
import os
import shutil
import tempfile
import time

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from datasets import SF_SMALL
from vigil.plans import lineage, training
from vigil.session import scratch_path
from vigil.sources import tables
from vigil.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def test_gate_is_strict_and_versions_ordered(spark):
    runs = spark.createDataFrame(
        [("r1", T0, 0.8), ("r2", T0, 0.81), ("r3", T0 + dt.timedelta(1), 0.9), ("r0", T0 + dt.timedelta(2), 0.95)],
        "run_id string, started timestamp, accuracy double",
    )
    v = {r.run_id: r.version for r in lineage.register_passing(runs, existing_max=4).collect()}
    assert v == {"r2": 5, "r3": 6, "r0": 7}
    latest = lineage.latest_versions(lineage.register_passing(runs)).first()
    assert (latest.version, latest.run_id) == (3, "r0")


def test_champion_and_alias(spark):
    versions = spark.createDataFrame([("m", 1, "a"), ("m", 2, "b")], "name string, version int, run_id string")
    events = spark.createDataFrame(
        [("m", "prod", 1, T0), ("m", "prod", 2, T0 + dt.timedelta(hours=1)), ("m", "prod", 1, T0 + dt.timedelta(hours=2))],
        "name string, alias string, version int, ts timestamp",
    )
    metrics = spark.createDataFrame([(T0, "a", "test_accuracy_score", 0.9)], "ts timestamp, run_id string, metric string, value double")
    ch = lineage.champion(events, versions, metrics).first()
    assert (ch.version, ch.run_id, ch.accuracy) == (1, "a", 0.9)
    events2 = events.filter("version = 2")
    ch2 = lineage.champion(events2, versions, metrics).first()
    assert (ch2.version, ch2.accuracy) == (2, 0.0)  # metric missing -> 0.0
    assert lineage.champion(events.filter("false"), versions, metrics).count() == 0


def test_run_name_and_local_time(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 20, 30, 0),)], "started timestamp_ntz")
    name = df.select(lineage.run_name(F.lit(3), lineage.local_stamp(df, "started")).alias("n")).first().n
    assert name == "sentiment_model_v3_20240102_033000"


def test_stream_equals_batch_for_closed_windows(spark):
    rows = [(i, T0 + dt.timedelta(minutes=7 * i), i % 2, (i // 2) % 2, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, y int, yhat int, value double")
    src = scratch_path(spark, "stream-src")
    for k in range(4):  # files arrive in time order, as an append-only feed would write them
        df.filter((F.col("event_id") >= 25 * k) & (F.col("event_id") < 25 * (k + 1))).coalesce(1).write.mode(
            "append"
        ).parquet(src)
        time.sleep(1.1)
    stream = jobs.ingest(spark, src, df.schema, max_files_per_trigger=1)
    windows = jobs.windowed_metrics(stream, watermark="1 hour")
    got = jobs.run_updates_to_parquet(windows, "window_start", scratch_path(spark, "stream-out"))
    batch = jobs.windowed_metrics_batch(df)
    g = {r.window_start: (r.n, r.accuracy, r.mean_value) for r in got.collect()}
    b = {r.window_start: (r.n, r.accuracy, r.mean_value) for r in batch.collect()}
    assert g == b  # the windows still open under the watermark included


@pytest.fixture(scope="module")
def small_model(spark):
    docs = tables.lang_reviews(spark, SF_SMALL)
    return docs, training.fit(docs)


def test_model_roundtrip_and_cache(spark, small_model):
    docs, fm = small_model
    path = tempfile.mkdtemp(prefix="vigil-model-")
    fm.model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    a = training.score(fm.model, docs).select("review_id", "prediction", "p1").orderBy("review_id").collect()
    b = training.score(loaded, docs).select("review_id", "prediction", "p1").orderBy("review_id").collect()
    assert [(x.prediction, round(x.p1, 12)) for x in a] == [(y.prediction, round(y.p1, 12)) for y in b]
    version = {"v": 1}
    cache = jobs.ModelCache(lambda: (version["v"], path))
    cache.current(), cache.current()
    assert cache.loads == 1
    version["v"] = 2
    cache.current()
    assert cache.loads == 2
    cache.resolve = lambda: None  # the alias is withdrawn
    assert cache.current() is None and cache.version is None


def test_training_beats_majority_and_is_at_optimum(spark, small_model):
    docs, fm = small_model
    scored = training.score(fm.model, docs)
    acc = scored.select(F.avg((F.col("prediction") == F.col("sentiment")).cast("double"))).first()[0]
    majority = docs.select(F.avg("sentiment")).first()[0]
    assert acc > max(majority, 1 - majority)
    feats = PipelineModel(stages=fm.model.stages[:-1]).transform(docs).select("features", "sentiment").collect()
    x = np.array([r.features.toArray() for r in feats])
    y = np.array([r.sentiment for r in feats], dtype=float)
    lr = fm.model.stages[-1]
    w, b = lr.coefficients.toArray(), lr.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    grad = x.T @ (p - y) + w  # gradient of sum(loss) + 0.5 * |w|^2, C = 1
    assert np.abs(grad).max() / len(y) < 1e-3


def test_lineage_resolver_follows_promotions(spark):
    aliases, versions = scratch_path(spark, "aliases"), scratch_path(spark, "versions")
    resolve = jobs.lineage_resolver(spark, aliases, versions)
    assert resolve() is None  # nothing written yet
    spark.createDataFrame(
        [(lineage.MODEL_NAME, 1, "r1", "/m/1", 0.9), (lineage.MODEL_NAME, 2, "r2", "/m/2", 0.95)],
        "name string, version int, run_id string, path string, accuracy double",
    ).write.parquet(versions)
    lineage.promote(spark, 1, ts="2024-01-01 00:00:00").write.mode("append").parquet(aliases)
    assert resolve() == (1, "/m/1")
    lineage.promote(spark, 2, ts="2024-01-02 00:00:00").write.mode("append").parquet(aliases)
    assert resolve() == (2, "/m/2")


def test_stream_scoring_equals_batch(spark, small_model):
    docs, fm = small_model
    src = scratch_path(spark, "score-src")
    docs.repartition(3).write.parquet(src)  # three files, one micro-batch each
    stream = jobs.ingest(spark, src, spark.read.parquet(src).schema, max_files_per_trigger=1)
    got = jobs.run_to_parquet(jobs.score_stream(fm.model, stream), scratch_path(spark, "score-out"))
    batch = training.score(fm.model, docs)
    g = {r.review_id: (r.prediction, round(r.p1, 12)) for r in got.collect()}
    b = {r.review_id: (r.prediction, round(r.p1, 12)) for r in batch.collect()}
    assert g == b


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_streams_as_a_file_or_a_folder(spark, files):
    folder = scratch_path(spark, "tables").removeprefix("file:")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    if files == 1:
        made = scratch_path(spark, "one").removeprefix("file:")
        docs.coalesce(1).write.parquet(made)
        os.makedirs(folder)
        [part] = [f for f in os.listdir(made) if f.endswith(".parquet")]
        shutil.copy(f"{made}/{part}", f"{folder}/documents.parquet")
    else:
        docs.repartition(files).write.parquet(f"{folder}/documents.parquet")
        docs.write.parquet(f"{folder}/events.parquet")  # a table beside it is not read
    stream = jobs.ingest_table(spark, folder, "documents", docs.schema)
    got = jobs.run_to_parquet(stream, scratch_path(spark, "streamed"))
    assert sorted(got.collect()) == sorted(docs.collect())
