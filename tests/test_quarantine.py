"""Bad rows are errors or rejects, never silent nulls; missing differs from empty."""

import pytest
from pyspark.sql import functions as F

from vigil.session import scratch_path
from vigil.sources import io, quarantine

CSV = '''Timestamp,Review,Sentiment
2024-01-02 03:04:05,good,1
2024-01-02 03:04:05,"",0
2024-01-02 03:04:05,,0
soon,bad time,1
2024-01-02 03:04:05,bad label,great
2024-01-02 03:04:05,too many,1,2
2024-01-02 03:04:05,"two
lines, ""quoted""",
'''


@pytest.fixture
def path(tmp_path):
    (tmp_path / "a.csv").write_text(CSV, encoding="utf-8")
    return str(tmp_path / "a.csv")


def test_every_row_is_good_or_a_reject(spark, path):
    out = quarantine.divided(io.judged_reviews_csv(spark, path), scratch_path(spark, "divided"))
    assert (out.n_in, out.n_good, out.n_rejects) == (7, 4, 3)
    good = sorted(((r.review, r.sentiment) for r in out.good.collect()), key=repr)
    assert good == sorted([("good", 1), ("", 0), (None, 0), ('two\nlines, "quoted"', None)], key=repr)
    reasons = {r.reason: r.raw for r in out.rejects.collect()}
    assert set(reasons) == {"Timestamp does not parse", "Sentiment does not parse", "fields do not fit the header"}
    assert "bad time" in reasons["Timestamp does not parse"] and "too many" in reasons["fields do not fit the header"]
    assert out.good.count() + out.rejects.count() == out.n_in and len(out.rejects.select("review_id").distinct().collect()) == 3


def test_a_bad_row_stops_the_plain_reader(spark, path, tmp_path):
    with pytest.raises(Exception, match="does not parse|do not fit"):
        io.read_reviews_csv(spark, path).count()
    clean = tmp_path / "b.csv"
    clean.write_text("Review,Sentiment\nfine,1\n", encoding="utf-8")
    row = io.read_reviews_csv(spark, str(clean)).first()
    assert (row.review, row.sentiment, row.ts) == ("fine", 1, None) and row.review_id is not None
    assert io.judged_reviews_csv(spark, str(tmp_path / "none.csv")).count() == 0


def test_csv_keeps_empty_and_missing_apart(spark):
    rows = [(1, None), (2, ""), (3, " a\r b "), (4, 'q"u,o\nte'), (5, "\\"), (6, '"'), (7, "NA"), (8, "\n")]
    path = scratch_path(spark, "csv")
    io.write_csv(spark.createDataFrame(rows, "id int, t string"), path)
    assert sorted(map(tuple, io.read_csv(spark, path, "id int, t string").collect())) == rows


def test_json_batches_are_not_lost(spark):
    batches = [
        (1, '[{"Review": "nice", "Sentiment": 1}, {"Review": "no label"}, {"Sentiment": 0}]'), (2, '{"Review": "single", "Sentiment": 0}'),
        (3, "not json"), (4, None), (5, "[]"), (6, '[{"Review": "half", "Sent'), (7, '[{"Review": "typed", "Sentiment": "x"}]'),
    ]
    df = spark.createDataFrame(batches, "b int, payload string")
    judged = quarantine.judged_json(df, "payload", io.BATCH_SCHEMA, ("Review", "Sentiment"))
    out = quarantine.divided(judged, scratch_path(spark, "json"))
    assert sorted((r.b, r.Review, r.Sentiment) for r in out.good.collect()) == [(1, "nice", 1), (2, "single", 0)]
    rejects = sorted((r.b, r.reason) for r in out.rejects.collect())
    assert [r for r in rejects if r[0] == 1] == [(1, "Review is missing"), (1, "Sentiment is missing")]
    assert {b for b, _ in rejects} == {1, 3, 6, 7} and out.n_in == out.n_good + out.n_rejects
    raw = {r.b: r.raw for r in out.rejects.collect()}
    assert raw[3] == "not json" and "half" in raw[6]
    with pytest.raises(Exception, match="bad row"):
        quarantine.strict(judged).select(F.count("Review")).collect()
