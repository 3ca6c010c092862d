"""The whole text report."""

from vigil.operators import evaluation as ev


def test_full_report_has_title_rows_and_four_decimal_scores(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 0, 0.1)], "y int, yhat int, p1 double")
    lines = [r.line for r in ev.full_report(df).orderBy("line_no").collect()]
    assert lines[:3] == ["Classification Report", "====================", ""]
    assert lines[3] == "Negative 0.67 1.00 0.80 2" and lines[4] == "Positive 1.00 0.50 0.67 2"
    assert [x.split()[0] for x in lines[5:8]] == ["accuracy", "macro", "weighted"] and lines[8] == ""
    assert lines[9:11] == ["ROC AUC Score: 0.8750", "Test Accuracy: 0.7500"]
    assert lines[11:14] == ["Test Precision (Macro): 0.8333", "Test Recall (Macro): 0.7500", "Test F1 Score (Macro): 0.7333"]
    assert lines[14].startswith("Test Log Loss: 0.4") and len(lines) == 15


def test_undefined_scores_are_named(spark):
    df = spark.createDataFrame([(1, 1, 0.9)], "y int, yhat int, p1 double")
    assert "ROC AUC Score: nan" in [r.line for r in ev.score_lines(df).collect()]


def test_the_report_reads_its_rows_once(spark, tmp_path):
    from pyspark.sql import functions as F
    from vigil.operators import evaluation

    path = str(tmp_path / "scored")
    spark.range(60).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3).cast("int").alias("yhat")).write.parquet(path)
    for report in (evaluation.classification_report, evaluation.macro_prf):
        plan = report(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Join" not in plan and "CartesianProduct" not in plan


def test_report_without_rows_and_with_nulls(spark):
    from vigil.operators import evaluation

    none = {r.label: r for r in evaluation.classification_report(spark.createDataFrame([], "y int, yhat int")).collect()}
    assert set(none) == {"accuracy", "macro avg", "weighted avg"} and none["accuracy"].f1_score == 0.0
    assert none["macro avg"].precision is None
    # a label never predicted, a prediction that is no label, rows that lack one of the two
    rows = spark.createDataFrame([(0, 0), (0, 0), (0, 2), (1, 0), (None, 1), (1, None), (3, None)], "y int, yhat int")
    got = {r.label: r for r in evaluation.classification_report(rows, names=["a", "b"]).collect()}
    assert {k: v.support for k, v in got.items()} == {"a": 3, "b": 1, "2": 0, "3": 0, "accuracy": 4, "macro avg": 4, "weighted avg": 4}
    assert (got["a"].precision, got["a"].recall) == (2 / 3, 2 / 3) and got["2"].precision == 0.0
    assert got["accuracy"].f1_score == 0.5 and abs(got["macro avg"].recall - (2 / 3) / 4) < 1e-12
