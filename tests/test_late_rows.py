"""Windowed metrics with a side output: every row is on time, late or undated, in any order of arrival."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vigil.session import scratch_path
from vigil.streaming.late import LateAwareWindows

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, y int, yhat int, value double"


def brute(batches, delay=dt.timedelta(hours=2), size=dt.timedelta(hours=1)):
    """Windows {start: rows on time} and the ids of late and undated rows, batch by batch."""
    newest, windows, late, undated = None, {}, set(), set()
    for batch in batches:
        mark = None if newest is None else newest - delay
        for row in batch:
            if row[1] is None:
                undated.add(row[0])
                continue
            start = T0 + (row[1] - T0) // size * size
            if mark is not None and start + size <= mark:
                late.add(row[0])
            else:
                windows.setdefault(start, []).append(row)
        seen = [r[1] for r in batch if r[1] is not None] + ([newest] if newest else [])
        newest = max(seen, default=None)
    return windows, late, undated


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_time_is_on_time_late_or_undated(spark, seed):
    rng = random.Random(seed)
    rows = [(i, T0 + dt.timedelta(minutes=3 * i), i % 2, rng.randrange(2), float(i)) for i in range(240)]
    rows = [(r[0], None if rng.random() < 0.03 else r[1], *r[2:]) for r in rows]
    rows.sort(key=lambda r: r[0] + rng.randrange(150))
    # a row exactly at the end of a window, an empty batch, rows without a value
    rows[5] = (*rows[5][:2], None, None, None)
    batches = [rows[:80], rows[80:160], [], rows[160:]]
    df = spark.createDataFrame([], SCHEMA)
    sink = LateAwareWindows(spark, scratch_path(spark, "late"), df.schema)
    for k, batch in enumerate(batches):
        sink(spark.createDataFrame(batch, SCHEMA), k)
        if k == 1:
            sink(spark.createDataFrame(batch, SCHEMA), k)  # a replay adds nothing
    windows, late, undated = brute(batches)
    assert late and undated
    got = {r.window_start: r for r in sink.windows().collect()}
    assert {w: r.n for w, r in got.items()} == {w: len(v) for w, v in windows.items()}
    for w, v in windows.items():
        judged = [r[2] == r[3] for r in v if r[2] is not None]
        valued = [r[4] for r in v if r[4] is not None]
        assert got[w].accuracy == (pytest.approx(sum(judged) / len(judged)) if judged else None)
        assert got[w].mean_value == (pytest.approx(sum(valued) / len(valued)) if valued else None)
    side = sink.late_rows().collect()
    assert {r.event_id for r in side if r.late_reason == "late"} == late
    assert {r.event_id for r in side if r.late_reason == "undated"} == undated
    for r in sink.progress().collect():
        assert r.n_in == r.n_on_time + r.n_late + r.n_undated == len(batches[r.batch_id])


def test_a_crash_before_the_commit_leaves_nothing(spark, monkeypatch):
    row = spark.createDataFrame([(1, T0, 1, 1, 2.0)], SCHEMA)
    sink = LateAwareWindows(spark, scratch_path(spark, "late"), row.schema)
    commit = sink.log.commit
    monkeypatch.setattr(sink.log, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        sink(row, 0)
    assert sink.windows().count() == 0 and sink.watermark().first().late_watermark is None
    monkeypatch.setattr(sink.log, "commit", commit)
    sink(row, 0)
    assert [(r.window_start, r.n) for r in sink.windows().collect()] == [(T0, 1)]
    assert sink.watermark().first().late_watermark == T0 - dt.timedelta(hours=2)


def test_names_of_the_side_output_are_refused(spark):
    clash = spark.createDataFrame([], SCHEMA).withColumn("late_reason", F.lit("x"))
    with pytest.raises(ValueError):
        LateAwareWindows(spark, scratch_path(spark, "late"), clash.schema)
