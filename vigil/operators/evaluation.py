"""Classifier evaluation as DataFrame aggregates.

Every metric is a grouped or global aggregate with partial (map-side) aggregation; the
only ordered quantities (ROC points, AUC) use the bucketed running totals, never a global
window. Conventions of the evaluated system: a ratio with a zero denominator is 0
(precision, recall, F1); AUC is undefined (null) when only one class is present; log loss
clips probabilities to [eps, 1 - eps] with eps the double machine epsilon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.cumulative import running_totals, settled

# Class names of the binary sentiment labels, in class order 0, 1.
CLASS_NAMES = ["Negative", "Positive"]
EPS = 2.220446049250313e-16


def _ratio(num, den):
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def accuracy(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """One row: accuracy (0.0 when empty), n, status ('ok' | 'no_data')."""
    agg = df.agg(
        F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("a"), F.count(F.lit(1)).alias("n")
    )
    return agg.select(
        F.coalesce("a", F.lit(0.0)).alias("accuracy"),
        "n",
        F.when(F.col("n") > 0, "ok").otherwise("no_data").alias("status"),
    )


def _cells(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """(y_true, y_pred, n) of the pairs that occur, nulls included: the one pass over the rows."""
    return df.groupBy(F.col(y).alias("y_true"), F.col(yhat).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """(y_true, y_pred, n): every pair of observed classes, zero cells included."""
    cells = _cells(df, y, yhat)
    classes = (
        cells.select(F.col("y_true").alias("c")).union(cells.select(F.col("y_pred").alias("c")))
        .filter(F.col("c").isNotNull()).distinct()
    )
    grid = classes.select(F.col("c").alias("y_true")).crossJoin(classes.select(F.col("c").alias("y_pred")))
    return grid.join(cells, ["y_true", "y_pred"], "left").select(
        "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def _class_counts(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """(cls, support, predicted, tp) of every observed class. A cell counts once for its true and once for
    its predicted class, so neither the grid nor a join is needed; rows without label or prediction count for nothing."""
    both = F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()
    n = F.when(both, F.col("n")).otherwise(F.lit(0))
    hit = F.when(F.col("y_true") == F.col("y_pred"), n).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    role = lambda c, support, predicted, tp: F.struct(
        F.col(c).alias("cls"), support.alias("support"), predicted.alias("predicted"), tp.alias("tp")
    )
    roles = F.array(role("y_true", n, zero, hit), role("y_pred", zero, n, zero))
    sides = _cells(df, y, yhat).select(F.inline(roles)).filter(F.col("cls").isNotNull())
    return sides.groupBy("cls").agg(*[F.sum(c).cast("long").alias(c) for c in ("support", "predicted", "tp")])


def _rates(counts: DataFrame) -> DataFrame:
    """(cls, precision, recall, f1_score, support, tp) from `_class_counts`."""
    p = _ratio(F.col("tp"), F.col("predicted"))
    r = _ratio(F.col("tp"), F.col("support"))
    return counts.select(
        "cls", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1_score"), "support", "tp"
    )


def per_class(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """(cls, precision, recall, f1_score, support): one row per observed class."""
    return _rates(_class_counts(df, y, yhat)).drop("tp")


def macro_prf(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """One row: precision_macro, recall_macro, f1_macro (unweighted means over classes)."""
    pc = per_class(df, y, yhat)
    return pc.agg(
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1_score").alias("f1_macro"),
    )


def classification_report(df: DataFrame, y: str = "y", yhat: str = "yhat", names: list[str] | None = None) -> DataFrame:
    """(label, precision, recall, f1_score, support): one row per class, then 'accuracy'
    (f1_score column holds the accuracy), 'macro avg' and 'weighted avg'."""
    names = names or CLASS_NAMES
    rates = _rates(_class_counts(df, y, yhat))
    # a row without class keeps the total there when no row has a label
    nobody = df.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rates.schema.fields])
    total = F.sum("support")
    mean = {c: F.avg(c) for c in ("precision", "recall", "f1_score")}
    weighted = {c: _ratio(F.sum(F.col(c) * F.col("support")), total) for c in mean}
    rolled = rates.unionByName(nobody).rollup("cls").agg(
        F.grouping("cls").alias("is_total"), total.alias("support"), _ratio(F.sum("tp"), total).alias("accuracy"),
        *[m.alias(c) for c, m in mean.items()], *[w.alias(f"w_{c}") for c, w in weighted.items()],
    ).filter("cls IS NOT NULL OR is_total = 1")
    name = F.try_element_at(F.array(*[F.lit(n) for n in names]), F.col("cls").cast("int") + 1)
    null = F.lit(None).cast("double")

    def line(label, precision, recall, f1_score):
        return F.struct(label.alias("label"), precision.alias("precision"), recall.alias("recall"),
                        f1_score.alias("f1_score"), F.col("support").alias("support"))

    of_class = line(F.coalesce(name, F.col("cls").cast("string")), *[F.col(c) for c in mean])
    of_all = [
        line(F.lit("accuracy"), null, null, F.col("accuracy")),
        line(F.lit("macro avg"), *[F.col(c) for c in mean]),
        line(F.lit("weighted avg"), *[F.col(f"w_{c}") for c in mean]),
    ]
    return rolled.select(F.inline(F.when(F.col("is_total") == 1, F.array(*of_all)).otherwise(F.array(of_class))))


def log_loss(df: DataFrame, y: str = "y", p1: str = "p1") -> DataFrame:
    """One row: log_loss = mean of -ln(p of the true class), p clipped to [eps, 1-eps], over the
    rows that have both a label and a probability."""
    scored = F.col(y).isNotNull() & F.col(p1).isNotNull()
    p = F.least(F.greatest(F.col(p1).cast("double"), F.lit(EPS)), F.lit(1.0 - EPS))
    p_true = F.when(F.col(y) == 1, p).otherwise(F.lit(1.0) - p)
    return df.agg(F.avg(F.when(scored, -F.log(p_true))).alias("log_loss"))


def _score_counts(df: DataFrame, y: str, p1: str) -> DataFrame:
    """Classes by distinct score, written once: totals, bounds and running sums read them, not the source."""
    return settled(df.groupBy(F.col(p1).cast("double").alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    ).filter(F.col("score").isNotNull()))


def roc_curve(df: DataFrame, y: str = "y", p1: str = "p1", num_buckets: int | None = None,
              drop_intermediate: bool = True) -> DataFrame:
    """(threshold, fpr, tpr): one point per distinct score, descending, plus the (0, 0)
    start point with a null threshold. With ``drop_intermediate`` (the evaluated library's
    default) a point is dropped when the step into it equals the step out of it (no change
    of direction); the first and last points are always kept."""
    counts = _score_counts(df, y, p1)
    totals = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    cum = running_totals(counts, "score", ["pos", "neg"], descending=True, num_buckets=num_buckets, materialize=False,
                         next_cols=["pos", "neg"] if drop_intermediate else None)
    if drop_intermediate:
        first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
        last = F.col("next_pos").isNull()
        turn = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        cum = cum.filter(first | last | turn)
    pts = cum.crossJoin(F.broadcast(totals)).select(
        F.col("score").alias("threshold"),
        F.when(F.col("N") > 0, F.col("cum_neg") / F.col("N")).alias("fpr"),
        F.when(F.col("P") > 0, F.col("cum_pos") / F.col("P")).alias("tpr"),
    )
    start = totals.select(
        F.lit(None).cast("double").alias("threshold"),
        F.when(F.col("N") > 0, F.lit(0.0)).alias("fpr"),
        F.when(F.col("P") > 0, F.lit(0.0)).alias("tpr"),
    )
    return start.unionByName(pts)


def roc_auc(df: DataFrame, y: str = "y", p1: str = "p1", num_buckets: int | None = None) -> DataFrame:
    """One row: roc_auc (ties count one half; null when a class is missing), n_pos, n_neg."""
    counts = _score_counts(df, y, p1)
    totals = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    cum = running_totals(counts, "score", ["neg"], num_buckets=num_buckets, materialize=False)
    # pos at s times (negatives strictly below s + half the negatives tied at s)
    pairs = cum.agg(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0)).alias("w"))
    return totals.crossJoin(pairs).select(
        F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("w") / (F.col("P") * F.col("N"))).alias("roc_auc"),
        F.coalesce(F.col("P"), F.lit(0)).cast("long").alias("n_pos"),
        F.coalesce(F.col("N"), F.lit(0)).cast("long").alias("n_neg"),
    )


def report_lines(df: DataFrame, y: str = "y", yhat: str = "yhat", names: list[str] | None = None) -> DataFrame:
    """(line_no, line): the plain-text evaluation report -- accuracy as a percentage with two
    decimals, then one line per report row with two-decimal precision/recall/F1 and support."""
    rep = classification_report(df, y, yhat, names)
    acc = accuracy(df, y, yhat).select(
        F.lit(0).cast("long").alias("line_no"),
        F.format_string("Accuracy: %.2f%%", F.round(F.col("accuracy") * 100, 2)).alias("line"),
    )
    order = (
        F.when(F.col("label") == "accuracy", 1000).when(F.col("label") == "macro avg", 1001)
        .when(F.col("label") == "weighted avg", 1002).otherwise(F.lit(None))
    )
    two = lambda c: F.when(F.col(c).isNull(), F.lit("")).otherwise(
        F.format_string("%.2f", F.round(F.col(c), 2))
    )
    body = rep.select(
        order.alias("o"), "label",
        F.concat_ws(" ", F.col("label"), two("precision"), two("recall"), two("f1_score"),
                    F.col("support").cast("string")).alias("line"),
    )
    # class rows are numbered by label text (few rows: one per class, bounded)
    from pyspark.sql import Window

    numbered = body.select(
        F.coalesce(F.col("o"), F.row_number().over(Window.orderBy("label"))).cast("long").alias("line_no"), "line"
    )
    return acc.unionByName(numbered)


# Title and metric lines of the monitored system's text report.
REPORT_TITLE = ("Classification Report", "====================")
SCORE_LINES = (
    ("ROC AUC Score", "roc_auc"), ("Test Accuracy", "accuracy"), ("Test Precision (Macro)", "precision_macro"),
    ("Test Recall (Macro)", "recall_macro"), ("Test F1 Score (Macro)", "f1_macro"), ("Test Log Loss", "log_loss"),
)


def score_lines(df: DataFrame, y: str = "y", yhat: str = "yhat", p1: str = "p1") -> DataFrame:
    """(line_no, line): the report's metrics with four decimals; an undefined one (AUC of one class) is ``nan``."""
    values = (  # one-row aggregates
        accuracy(df, y, yhat).select("accuracy").crossJoin(macro_prf(df, y, yhat).select("precision_macro", "recall_macro", "f1_macro"))
        .crossJoin(roc_auc(df, y, p1).select("roc_auc")).crossJoin(log_loss(df, y, p1))
    )
    four = lambda c: F.when(F.col(c).isNull(), "nan").otherwise(F.format_string("%.4f", F.round(F.col(c), 4)))
    lines = [F.struct(F.lit(i).cast("long").alias("line_no"), F.concat(F.lit(f"{name}: "), four(c)).alias("line")) for i, (name, c) in enumerate(SCORE_LINES)]
    return values.select(F.inline(F.array(*lines)))


def full_report(df: DataFrame, y: str = "y", yhat: str = "yhat", p1: str = "p1", names: list[str] | None = None) -> DataFrame:
    """(line_no, line): the whole text report: title, a line per report row, then the metrics with four decimals."""
    title = df.sparkSession.createDataFrame([(i - 10, t) for i, t in enumerate((*REPORT_TITLE, ""))], "line_no long, line string")
    body = report_lines(df, y, yhat, names).filter("line_no > 0")
    scores = score_lines(df, y, yhat, p1).select((F.col("line_no") + F.lit(2000)).alias("line_no"), "line")
    gap = df.sparkSession.createDataFrame([(1500, "")], "line_no long, line string")
    return title.unionByName(body).unionByName(gap).unionByName(scores)
