"""Evaluation queries: accuracy, confusion matrix, report, log loss, ROC, AUC, class and
text statistics over the split training table."""

from __future__ import annotations


from vigil.operators import evaluation as ev
from vigil.plans.catalog import register, rounded
from vigil.plans.summary import class_distribution, text_statistics
from vigil.sources import tables

_ACC = """SELECT round(coalesce(avg(CAST(quality = toxic AS DOUBLE)), 0.0), 6) AS accuracy, count(*) AS n,
       CASE WHEN count(*) > 0 THEN 'ok' ELSE 'no_data' END AS status FROM labels"""

_CM = """cells AS (SELECT quality AS y_true, toxic AS y_pred, count(*) AS n FROM labels GROUP BY ALL),
cl AS (SELECT c FROM (SELECT y_true AS c FROM cells UNION SELECT y_pred FROM cells) WHERE c IS NOT NULL),
cm AS (SELECT a.c AS y_true, b.c AS y_pred, coalesce(cells.n, 0)::BIGINT AS n
       FROM cl a CROSS JOIN cl b LEFT JOIN cells ON cells.y_true = a.c AND cells.y_pred = b.c)"""

_PC = """bt AS (SELECT y_true AS cls, sum(n) AS support, sum(CASE WHEN y_true = y_pred THEN n END) AS tp FROM cm GROUP BY 1),
bp AS (SELECT y_pred AS cls, sum(n) AS predicted FROM cm GROUP BY 1),
pc0 AS (SELECT bt.cls, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r, support::BIGINT AS support
        FROM bt JOIN bp USING (cls)),
pc AS (SELECT cls, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f, support FROM pc0)"""

_SCORED = """sc AS (SELECT CAST(event_type = 'purchase' AS INTEGER) AS y, value / (value + 50.0) AS p1 FROM events)"""


@register("accuracy", _ACC)
def q_accuracy(spark, sf_dir):
    return rounded(ev.accuracy(tables.predictions(spark, sf_dir)))


@register("confusion_matrix", f"WITH {_CM} SELECT * FROM cm")
def q_confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(tables.predictions(spark, sf_dir))


@register(
    "classification_report",
    f"""WITH {_CM}, {_PC},
acc AS (SELECT avg(CAST(quality = toxic AS DOUBLE)) AS a FROM labels),
agg AS (SELECT avg(p) AS mp, avg(r) AS mr, avg(f) AS mf, sum(p * support) / sum(support) AS wp,
               sum(r * support) / sum(support) AS wr, sum(f * support) / sum(support) AS wf,
               sum(support)::BIGINT AS support FROM pc)
SELECT coalesce(['Negative', 'Positive'][cls + 1], CAST(cls AS VARCHAR)) AS label,
       round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, support FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, round(a, 6), support FROM agg, acc
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), support FROM agg
UNION ALL SELECT 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), support FROM agg""",
)
def q_classification_report(spark, sf_dir):
    return rounded(ev.classification_report(tables.predictions(spark, sf_dir)))


@register(
    "macro_prf",
    f"""WITH {_CM}, {_PC}
SELECT round(avg(p), 6) AS precision_macro, round(avg(r), 6) AS recall_macro, round(avg(f), 6) AS f1_macro FROM pc""",
)
def q_macro_prf(spark, sf_dir):
    return rounded(ev.macro_prf(tables.predictions(spark, sf_dir)))


@register(
    "log_loss",
    f"""WITH {_SCORED}
SELECT round(avg(-ln(CASE WHEN y = 1 THEN least(greatest(p1, 2.220446049250313e-16), 1 - 2.220446049250313e-16)
                          ELSE 1 - least(greatest(p1, 2.220446049250313e-16), 1 - 2.220446049250313e-16) END)), 6)
       AS log_loss FROM sc""",
)
def q_log_loss(spark, sf_dir):
    return rounded(ev.log_loss(tables.scored_events(spark, sf_dir)))


_COUNTS = """g AS (SELECT p1 AS score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg
      FROM sc WHERE p1 IS NOT NULL GROUP BY p1),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM g)"""


@register(
    "roc_curve",
    f"""WITH {_SCORED}, {_COUNTS},
c0 AS (SELECT score, pos, neg,
             sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp,
             sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn,
             lead(pos) OVER (ORDER BY score DESC) AS np, lead(neg) OVER (ORDER BY score DESC) AS nn,
             row_number() OVER (ORDER BY score DESC) AS rn FROM g),
c AS (SELECT * FROM c0 WHERE rn = 1 OR np IS NULL OR np <> pos OR nn <> neg)
SELECT NULL::DOUBLE AS threshold, CASE WHEN N > 0 THEN 0.0 END AS fpr, CASE WHEN P > 0 THEN 0.0 END AS tpr FROM t
UNION ALL
SELECT round(score, 6), round(CASE WHEN N > 0 THEN cn / N END, 6), round(CASE WHEN P > 0 THEN cp / P END, 6) FROM c, t""",
)
def q_roc_curve(spark, sf_dir):
    return rounded(ev.roc_curve(tables.scored_events(spark, sf_dir)))


@register(
    "roc_auc",
    f"""WITH {_SCORED}, {_COUNTS},
c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cn FROM g)
SELECT round(CASE WHEN P > 0 AND N > 0 THEN (SELECT sum(pos * (cn - neg / 2.0)) FROM c) / (P * N) END, 6) AS roc_auc,
       coalesce(P, 0)::BIGINT AS n_pos, coalesce(N, 0)::BIGINT AS n_neg FROM t""",
)
def q_roc_auc(spark, sf_dir):
    return rounded(ev.roc_auc(tables.scored_events(spark, sf_dir)))


_SPLIT_REVIEWS = """r AS (SELECT d.doc_id, d.text AS review, l.quality AS sentiment
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(concat('42', ':', CAST(doc_id AS VARCHAR))), doc_id)
                          <= ceil(0.2::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM r)"""


@register(
    "class_distribution",
    f"""WITH {_SPLIT_REVIEWS}
SELECT coalesce(split, 'overall') AS scope, sentiment, count(*) AS n FROM s
GROUP BY GROUPING SETS ((split, sentiment), (sentiment))""",
)
def q_class_distribution(spark, sf_dir):
    from vigil.operators.sampling import exact_split

    split = exact_split(tables.reviews(spark, sf_dir), "review_id", 0.2, 42)
    return class_distribution(split)


_WORDS = "len(list_filter(regexp_split_to_array(review, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))"


@register(
    "text_statistics",
    f"""WITH {_SPLIT_REVIEWS}
SELECT CAST(trunc(avg(length(review))) AS BIGINT) AS avg_review_length_chars,
       CAST(max(length(review)) AS BIGINT) AS max_review_length_chars,
       CAST(min(length(review)) AS BIGINT) AS min_review_length_chars,
       CAST(trunc(avg({_WORDS})) AS BIGINT) AS avg_review_length_words,
       CAST(trunc(avg(length(review)) FILTER (WHERE split = 'train')) AS BIGINT) AS train_avg_length_chars,
       CAST(trunc(avg(length(review)) FILTER (WHERE split = 'test')) AS BIGINT) AS test_avg_length_chars
FROM s""",
)
def q_text_statistics(spark, sf_dir):
    from vigil.operators.sampling import exact_split

    split = exact_split(tables.reviews(spark, sf_dir), "review_id", 0.2, 42)
    return text_statistics(split)




@register(
    "report_text",
    f"""WITH {_CM}, {_PC},
acc AS (SELECT avg(CAST(quality = toxic AS DOUBLE)) AS a FROM labels),
agg AS (SELECT avg(p) AS mp, avg(r) AS mr, avg(f) AS mf, sum(p * support) / sum(support) AS wp,
               sum(r * support) / sum(support) AS wr, sum(f * support) / sum(support) AS wf,
               sum(support)::BIGINT AS support FROM pc),
rows AS (
  SELECT coalesce(['Negative', 'Positive'][cls + 1], CAST(cls AS VARCHAR)) AS label, p, r, f, support, NULL::BIGINT AS o FROM pc
  UNION ALL SELECT 'accuracy', NULL, NULL, a, support, 1000 FROM agg, acc
  UNION ALL SELECT 'macro avg', mp, mr, mf, support, 1001 FROM agg
  UNION ALL SELECT 'weighted avg', wp, wr, wf, support, 1002 FROM agg)
SELECT 0::BIGINT AS line_no, printf('Accuracy: %.2f%%', round(a * 100, 2)) AS line FROM acc
UNION ALL
SELECT coalesce(o, row_number() OVER (ORDER BY label))::BIGINT,
       concat_ws(' ', label, coalesce(printf('%.2f', round(p, 2)), ''), coalesce(printf('%.2f', round(r, 2)), ''),
                 coalesce(printf('%.2f', round(f, 2)), ''), CAST(support AS VARCHAR))
FROM rows""",
)
def q_report_text(spark, sf_dir):
    return ev.report_lines(tables.predictions(spark, sf_dir))


@register(
    "report_scores",
    f"""WITH {_SCORED}, {_COUNTS},
c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cn FROM g),
sp AS (SELECT y, p1, CAST(p1 >= 0.5 AS INTEGER) AS yhat FROM sc),
cm AS (SELECT k, count(*) FILTER (WHERE y = k AND yhat = k) AS tp, count(*) FILTER (WHERE yhat = k) AS said,
              count(*) FILTER (WHERE y = k) AS is_k FROM sp, (VALUES (0), (1)) v(k) GROUP BY k),
pr AS (SELECT CASE WHEN said > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN is_k > 0 THEN tp / is_k ELSE 0 END AS r FROM cm),
m AS (SELECT avg(p) AS p, avg(r) AS r, avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS f FROM pr),
v AS (SELECT (SELECT sum(pos * (cn - neg / 2.0)) FROM c) / (t.P * t.N) AS auc, m.p, m.r, m.f,
             (SELECT avg(CAST(y = yhat AS DOUBLE)) FROM sp) AS acc,
             (SELECT avg(-ln(CASE WHEN y = 1 THEN least(greatest(p1, 2.220446049250313e-16), 1 - 2.220446049250313e-16)
                                  ELSE 1 - least(greatest(p1, 2.220446049250313e-16), 1 - 2.220446049250313e-16) END)) FROM sc) AS ll
      FROM t, m)
SELECT CAST(i AS BIGINT) AS line_no, concat(name, ': ', printf('%.4f', round(x, 4))) AS line FROM (
  SELECT 0 AS i, 'ROC AUC Score' AS name, auc AS x FROM v UNION ALL SELECT 1, 'Test Accuracy', acc FROM v
  UNION ALL SELECT 2, 'Test Precision (Macro)', p FROM v UNION ALL SELECT 3, 'Test Recall (Macro)', r FROM v
  UNION ALL SELECT 4, 'Test F1 Score (Macro)', f FROM v UNION ALL SELECT 5, 'Test Log Loss', ll FROM v)""",
)
def q_report_scores(spark, sf_dir):
    from pyspark.sql import functions as F

    scored = tables.scored_events(spark, sf_dir).withColumn("yhat", (F.col("p1") >= 0.5).cast("int"))
    return ev.score_lines(scored)


@register(
    "split_counts",
    f"""WITH {_SPLIT_REVIEWS}
SELECT count(*) AS total_samples, count(*) FILTER (WHERE split = 'train') AS train_samples,
       count(*) FILTER (WHERE split = 'test') AS test_samples FROM s""",
)
def q_split_counts(spark, sf_dir):
    from pyspark.sql import functions as F

    from vigil.operators.sampling import exact_split

    split = exact_split(tables.reviews(spark, sf_dir), "review_id", 0.2, 42)
    return split.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(F.col("split") == "train").alias("train_samples"),
        F.count_if(F.col("split") == "test").alias("test_samples"),
    )
