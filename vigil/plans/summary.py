"""Data summary of a training run: counts, class distribution, text statistics, model
performance, assembled as one nested row (written with ``df.write.json``).

Input: the split training table ``(review_id, review, sentiment, split)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import char_length, word_count


def class_distribution(split: DataFrame, label_col: str = "sentiment") -> DataFrame:
    """(scope, sentiment, n): per split and overall, one shuffle via grouping sets."""
    g = split.groupingSets([["split", label_col], [label_col]], "split", label_col).agg(
        F.count(F.lit(1)).alias("n")
    )
    return g.select(F.coalesce("split", F.lit("overall")).alias("scope"), F.col(label_col).alias("sentiment"), "n")


def text_statistics(split: DataFrame, text_col: str = "review") -> DataFrame:
    """One row of truncated integer statistics, computed in a single aggregate."""
    n = char_length(text_col)
    w = word_count(text_col)
    trunc = lambda c: c.cast("bigint")  # noqa: E731  (truncation toward zero, like int())
    return split.agg(
        trunc(F.avg(n)).alias("avg_review_length_chars"),
        F.max(n).cast("bigint").alias("max_review_length_chars"),
        F.min(n).cast("bigint").alias("min_review_length_chars"),
        trunc(F.avg(w)).alias("avg_review_length_words"),
        trunc(F.avg(F.when(F.col("split") == "train", n))).alias("train_avg_length_chars"),
        trunc(F.avg(F.when(F.col("split") == "test", n))).alias("test_avg_length_chars"),
    )


def data_summary(split: DataFrame, performance: DataFrame, label_col: str = "sentiment",
                 source: str = "reviews", test_ratio: float = 0.2) -> DataFrame:
    """One nested row: dataset_info, class_distribution, text_statistics, model_performance.

    ``performance`` is a one-row frame with test_accuracy, test_precision, test_recall,
    test_f1_score, test_roc_auc, test_log_loss.
    """
    y = F.col(label_col)
    counts = split.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(F.col("split") == "train").alias("train_samples"),
        F.count_if(F.col("split") == "test").alias("test_samples"),
        *[
            F.count_if((y == c) & scope).alias(f"{name}_{c}")
            for name, scope in (("overall", F.lit(True)), ("train", F.col("split") == "train"),
                                ("test", F.col("split") == "test"))
            for c in (0, 1)
        ],
    )
    stats = text_statistics(split)
    row = counts.crossJoin(stats).crossJoin(performance)
    dist = lambda s: F.struct(F.col(f"{s}_0").alias("negative (0)"), F.col(f"{s}_1").alias("positive (1)"))
    return row.select(
        F.struct(
            F.lit(source).alias("original_dataset_path"),
            "total_samples",
            "train_samples",
            "test_samples",
            F.lit(test_ratio).alias("test_split_ratio"),
            F.array(F.lit("Review")).alias("features"),
            F.lit("Sentiment").alias("target"),
        ).alias("dataset_info"),
        F.struct(dist("overall").alias("overall"), dist("train").alias("train"), dist("test").alias("test")).alias(
            "class_distribution"
        ),
        F.struct(*[F.col(c) for c in stats.columns]).alias("text_statistics"),
        F.struct(*[F.col(c) for c in performance.columns]).alias("model_performance"),
    )
