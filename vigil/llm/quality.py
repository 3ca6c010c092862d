"""Quality rules: gradient-boosted trees over document statistics, behind two base rules.

Statistics of the whole text are computed once per row. The trees (logistic loss, histogram
splits) are trained here on labelled documents: at most ``MAX_TRAIN`` of them, those with
the smallest hash of the id, which bounds what reaches the driver. Features with a stated
direction are monotone: a split that would go against it is not made, and the bound
is handed down to both sides. The trees are complete and flattened into arrays
(feature, threshold, leaf), so a batch of rows descends all trees by array indexing.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import documents

MAX_TRAIN = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Largest share of labelled good documents (held out) that the verdict may reject.
MAX_LOSS = 0.002
FOLDS = 4
TREES, DEPTH, RATE, BINS, LEAST = 60, 3, 0.15, 32, 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_chars", "n_lines", "n_digits", "n_upper", "n_stops", "n_distinct_words"]
STATISTICS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS + EXTRA])

#: Model features and the direction in which they may move the score (1 up, -1 down, 0 free).
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "digit_share": 0,
    "upper_share": 0,
    "stops_per_word": 0,
    "distinct_share": 0,
    "words_per_line": 0,
}

_BLANKS, _SYMBOLS, _STOPS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b".!?"
_DIGITS, _UPPER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS then EXTRA of one whole text; a null text counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    without = lambda drop: len(data) - len(data.translate(None, drop))
    words = data.split()
    lines = data.split(b"\n")
    worded = [x for x in lines if x.strip()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        often, mark = Counter(windows), bytearray(len(words))
        for i, w in enumerate(windows):
            if often[w] > 1:
                mark[i:i + 3] = b"\x01\x01\x01"
        repeated = sum(mark)
    return (
        len(words), len(text) - without(_BLANKS), without(_SYMBOLS), len(worded) - len(set(worded)), repeated,
        len(text), len(worded), without(_DIGITS), without(_UPPER), without(_STOPS), len(set(words)),
    )


@F.pandas_udf(STATISTICS)
def statistics_udf(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_statistics(t) for t in text], columns=COUNTS + EXTRA)


def feature_matrix(s: pd.DataFrame) -> np.ndarray:
    v = {c: s[c].to_numpy(dtype=np.float64) for c in COUNTS + EXTRA}
    words, chars, lines = np.maximum(v["n_words"], 1), np.maximum(v["n_chars"], 1), np.maximum(v["n_lines"], 1)
    columns = {
        "log_words": np.log1p(v["n_words"]),
        "word_length": v["word_chars"] / words,
        "symbols_per_word": v["n_symbols"] / words,
        "dup_line_share": v["n_dup_lines"] / lines,
        "repeat_share": v["n_repeat_words"] / words,
        "digit_share": v["n_digits"] / chars,
        "upper_share": v["n_upper"] / chars,
        "stops_per_word": v["n_stops"] / words,
        "distinct_share": v["n_distinct_words"] / words,
        "words_per_line": words / lines,
    }
    return np.column_stack([columns[name] for name in FEATURES])


@dataclass
class Trees:
    """Complete trees in heap order: node k has children 2k+1 (<= threshold) and 2k+2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out


def train(x: np.ndarray, y: np.ndarray, directions: list[int], trees=TREES, depth=DEPTH, rate=RATE) -> Trees:
    """Boosted trees of second-order logistic loss; no rows or one class give a constant."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    none = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    if len(y) == 0 or y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    margin = np.full(len(y), base)
    kept = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            low[2 * k + 1:2 * k + 3], high[2 * k + 1:2 * k + 3] = low[k], high[k]
            best = _best_split(binned[rows], grad[rows], hess[rows], cuts, directions, low[k], high[k])
            if best:
                j, cut, left, right = best
                feature[k], threshold[k] = j, cuts[j][cut]
                if directions[j]:
                    middle = (left + right) / 2
                    (high if directions[j] > 0 else low)[2 * k + 1] = middle
                    (low if directions[j] > 0 else high)[2 * k + 2] = middle
            node[rows] = 2 * k + 1 + (x[rows, feature[k]] > threshold[k])
        leaf = np.zeros(leaves)
        for i in range(leaves):
            rows = node == inner + i
            value = grad[rows].sum() / (hess[rows].sum() + 1)
            leaf[i] = rate * np.clip(value, low[inner + i], high[inner + i])
        margin += leaf[node - inner]
        for store, value in zip(kept, (feature, threshold, leaf)):
            store.append(value)
    return Trees(*(np.array(k) for k in kept), base)


def _best_split(binned, grad, hess, cuts, directions, low, high):
    if len(grad) < 2 * LEAST:
        return None
    g, h, best, gain_to_beat = grad.sum(), hess.sum(), None, 1e-3
    for j, direction in enumerate(directions):
        if not len(cuts[j]):
            continue
        width = len(cuts[j]) + 1
        n_left = np.cumsum(np.bincount(binned[:, j], minlength=width))[:-1]
        g_left = np.cumsum(np.bincount(binned[:, j], grad, width))[:-1]
        h_left = np.cumsum(np.bincount(binned[:, j], hess, width))[:-1]
        left = np.clip(g_left / (h_left + 1), low, high)
        right = np.clip((g - g_left) / (h - h_left + 1), low, high)
        gain = g_left**2 / (h_left + 1) + (g - g_left) ** 2 / (h - h_left + 1) - g**2 / (h + 1)
        allowed = (n_left >= LEAST) & (len(grad) - n_left >= LEAST) & ((right - left) * direction >= 0)
        gain = np.where(allowed, gain, -np.inf)
        at = int(gain.argmax())
        if gain[at] > gain_to_beat:
            gain_to_beat, best = gain[at], (j, at, left[at], right[at])
    return best


@dataclass
class Verdict:
    """A trained model and the margin from which a document is good."""

    trees: Trees
    threshold: float


def fit(labelled: pd.DataFrame) -> Verdict:
    """Fit on statistics plus ``quality``; the threshold is the margin that loses at most
    MAX_LOSS of the good documents when each fold is scored by trees of the other folds."""
    x, y = feature_matrix(labelled), labelled["quality"].to_numpy(dtype=np.float64)
    directions = list(FEATURES.values())
    trees = train(x, y, directions)
    if not len(trees.leaf):
        return Verdict(trees, -np.inf)
    fold, held = np.arange(len(y)) % FOLDS, np.zeros(len(y))
    for f in range(FOLDS):
        held[fold == f] = train(x[fold != f], y[fold != f], directions).margin(x[fold == f])
    good = np.sort(held[y == 1])
    return Verdict(trees, float(min(0.0, good[int(len(good) * MAX_LOSS)])))


def labelled_statistics(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> pd.DataFrame:
    """Statistics and label of at most ``limit`` labelled documents (smallest hash of the id)."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter("quality IN (0, 1) AND doc_id IS NOT NULL")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    # `chosen` has at most `limit` rows of 12 bytes: safe to broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    table = rows.select("doc_id", "quality", statistics_udf("text").alias("s")).select("doc_id", "quality", "s.*")
    return table.orderBy("doc_id").limit(limit).toPandas()


def judged(docs: DataFrame, verdict: Verdict) -> DataFrame:
    """``docs`` with a struct ``__quality``: COUNTS, base_failed, score, kept."""

    @F.pandas_udf("double")
    def score(s: pd.DataFrame) -> pd.Series:
        return pd.Series(verdict.trees.margin(feature_matrix(s)))

    stats = docs.withColumn("__stats", statistics_udf("text"))
    stats = stats.withColumn("__score", score("__stats"))
    s = F.col("__stats")
    failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
    fields: list[Column] = [s[c].alias(c) for c in COUNTS]
    fields += [
        failed.alias("base_failed"), F.col("__score").alias("score"),
        (~failed & (F.col("__score") >= F.lit(verdict.threshold))).alias("kept"),
    ]
    return stats.withColumn("__quality", F.struct(*fields)).drop("__stats", "__score")


def quality_rules(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None) -> DataFrame:
    """Every row of ``docs`` with ``__quality``. A null text counts as empty (and fails the base
    rules); labels that are null or neither 0 nor 1 are left out, an id with several takes the
    smallest; without labels of both classes the base rules decide alone; repeated rows are
    judged alike; columns of ``docs`` beside text pass through."""
    verdict = fit(labelled_statistics(train_docs if train_docs is not None else docs, labels))
    return judged(docs, verdict)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality_rules(docs, labels)
    return out.select("doc_id", *[f"__quality.{c}" for c in [*COUNTS, "base_failed", "kept", "score"]])
