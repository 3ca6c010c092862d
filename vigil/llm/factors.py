"""Quality classifier: a factorisation machine over hashed words, text statistics and metadata.

A document is a sparse vector: BUCKETS hashed words (dampened counts, unit length together), the statistics
of its structure and its metadata (standardised). Every feature has a weight and RANK factors;
a pair of features interacts by the product of their factors. The sum over all pairs is taken in linear time:
half of (square of the sum less sum of the squares), a factor at a time.

The model is fitted here, by Adam on the logistic loss, on at most ``MAX_FIT`` labelled documents
(those with the smallest hash of the id); that is what reaches the driver. Scoring needs one pass
over the texts and no exchange.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import documents
from vigil.llm.quality import COUNTS, EXTRA, FEATURES, feature_matrix, text_statistics

BUCKETS, RANK = 4096, 8
#: Labelled documents that the fit sees, at most.
MAX_FIT = 8_000
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY, SEED = 12, 600, 128, 0.01, 1e-4, 7
#: Standardised features are cut here, so that no outlier outweighs the rest.
CLIP = 4.0
THRESHOLD = 0.7
FOLDS, HELD_FOLD = 4, 2

WORDS_OF = "buckets binary, values binary, shape binary"


def hashed_words(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text's words without regard to ASCII case: 1 + ln(count) a bucket, scaled to
    unit length. Words that share a bucket count as one."""
    counts = Counter((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not counts:
        return np.zeros(0, np.uint16), np.zeros(0, np.float32)
    bucket = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) % BUCKETS
    total = np.bincount(bucket, np.fromiter(counts.values(), np.float64, len(counts)), BUCKETS)
    used = np.flatnonzero(total)
    value = 1 + np.log(total[used])
    return used.astype(np.uint16), (value / np.sqrt((value**2).sum())).astype(np.float32)


def structure(texts: list[str | None], metadata: np.ndarray) -> np.ndarray:
    """Statistics of each text and its metadata (numbers, damped; a missing one is NaN)."""
    stats = pd.DataFrame([text_statistics(t) for t in texts], columns=COUNTS + EXTRA)
    return np.column_stack([feature_matrix(stats), np.sign(metadata) * np.log1p(np.abs(metadata))])


@dataclass
class Sparse:
    """Hashed words of several documents, one behind the other."""

    bucket: np.ndarray
    value: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(words: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        if not words:
            return Sparse(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        ends = np.cumsum([len(b) for b, _ in words])
        return Sparse(np.concatenate([b for b, _ in words]).astype(np.int64), np.concatenate([v for _, v in words]).astype(np.float64), ends)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of each document: the sum of its words' values."""
        total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
        return np.diff(total[np.r_[0, self.ends]], axis=0)

    def dense(self, chosen: np.ndarray) -> np.ndarray:
        out = np.zeros((len(chosen), BUCKETS), np.float32)
        starts = np.r_[0, self.ends]
        for i, d in enumerate(chosen.tolist()):
            part = slice(starts[d], starts[d + 1])
            out[i, self.bucket[part]] = self.value[part]
        return out


@dataclass
class Machine:
    """Weights and factors of the words, then of the standardised features."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, dense: np.ndarray) -> np.ndarray:
        return np.nan_to_num(np.clip((dense - self.mean) / self.scale, -CLIP, CLIP))

    def margin(self, words: Sparse, dense: np.ndarray) -> np.ndarray:
        x = self.standard(dense)
        w, v = self.weight[words.bucket] * words.value, self.factor[words.bucket] * words.value[:, None]
        each = words.sums(np.column_stack([w, v, v**2]))
        linear = self.bias + each[:, 0] + x @ self.weight[BUCKETS:]
        total = each[:, 1:1 + RANK] + x @ self.factor[BUCKETS:]
        squares = each[:, 1 + RANK:] + x**2 @ self.factor[BUCKETS:] ** 2
        return linear + 0.5 * (total**2 - squares).sum(1)

    def score(self, words: Sparse, dense: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(words, dense), -500, 500)))


def fit(words: Sparse, dense: np.ndarray, y: np.ndarray) -> Machine:
    """Adam on the mean logistic loss, EPOCHS times over the rows and LEAST_STEPS steps at least; no rows or one class leave the share of that class as score."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    seen = ~np.isnan(dense)
    count = np.maximum(seen.sum(0), 1)
    mean = np.where(seen, dense, 0).sum(0) / count
    spread = np.sqrt(np.where(seen, (dense - mean) ** 2, 0).sum(0) / count)
    n = BUCKETS + dense.shape[1]
    rng = np.random.default_rng(SEED)
    model = Machine(
        float(np.log(share / (1 - share))), np.zeros(n, np.float32), np.zeros((n, RANK), np.float32), mean, np.where(spread > 1e-9, spread, 1.0)
    )
    if not len(y) or y.min() == y.max():
        return model
    factor = rng.normal(0, 0.05, (n, RANK)).astype(np.float32)
    table, bias = np.column_stack([model.weight, factor]), np.float32(model.bias)
    first, second, step = np.zeros_like(table), np.zeros_like(table), 0
    x = model.standard(dense).astype(np.float32)
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(y)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for begin in range(0, len(y), BATCH):
            chosen = order[begin:begin + BATCH]
            row = np.concatenate([words.dense(chosen), x[chosen]], axis=1)
            square = row**2
            w, v = table[:, 0], table[:, 1:]
            total = row @ v
            margin = bias + row @ w + 0.5 * (total**2 - square @ v**2).sum(1)
            off = ((1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y[chosen]) / len(chosen)).astype(np.float32)
            grad = np.column_stack([off @ row, row.T @ (off[:, None] * total) - (off @ square)[:, None] * v]) + DECAY * table
            step += 1
            first += 0.1 * (grad - first)
            second += 0.001 * (grad**2 - second)
            table = table - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            bias -= rate * off.sum() * 10
    model.bias, model.weight, model.factor = float(bias), table[:, 0].astype(np.float64), table[:, 1:].astype(np.float64)
    return model


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))


def _numbers(docs: DataFrame, metadata: list[str]):
    """Metadata columns as one array of doubles."""
    return F.array(*[docs[c].cast("double") for c in metadata]).cast("array<double>")


def _matrix(column, width: int) -> np.ndarray:
    rows = [[np.nan if x is None else x for x in r] for r in column.to_pylist()]
    return np.array(rows, np.float64).reshape(len(rows), width)


def _features(width: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(2).to_pylist()
            words = [hashed_words(t) for t in texts]
            shape = structure(texts, _matrix(batch.column(3), width)) if texts else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([b.tobytes() for b, _ in words], pa.binary()),
                    pa.array([v.tobytes() for _, v in words], pa.binary()), pa.array([s.tobytes() for s in shape], pa.binary()),
                ],
                ["doc_id", "quality", "buckets", "values", "shape"],
            )

    return run


def fitted(docs: DataFrame, labels: DataFrame, metadata: list[str], limit: int = MAX_FIT) -> Machine:
    """Fit on at most ``limit`` labelled documents that are not held out."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(~_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), _numbers(docs, metadata).alias("numbers"))
    # `chosen` has at most `limit` rows of 12 bytes: safe to broadcast
    rows = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text", "numbers")
    table = rows.mapInArrow(_features(len(metadata)), f"doc_id long, quality int, {WORDS_OF}")
    table = table.orderBy("doc_id", F.xxhash64("buckets", "values", "shape")).limit(limit).toPandas()  # rows of one id may be many
    words = [(np.frombuffer(b, np.uint16), np.frombuffer(v, np.float32)) for b, v in zip(table["buckets"], table["values"])]
    width = len(FEATURES) + len(metadata)
    dense = np.array([np.frombuffer(s, np.float64) for s in table["shape"]]).reshape(len(table), width)
    return fit(Sparse.of(words), dense, table["quality"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Machine, metadata: list[str]) -> DataFrame:
    """``docs`` with a column ``__score``; the columns of ``docs`` pass through."""
    width = len(metadata)
    schema = T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())])
    text_at = docs.columns.index("text")
    n = len(docs.columns)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            score = np.zeros(batch.num_rows)
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                texts = part.column(text_at).to_pylist()
                words = Sparse.of([hashed_words(t) for t in texts])
                score[begin:begin + 512] = model.score(words, structure(texts, _matrix(part.column(n), width)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(score)], [*batch.schema.names[:n], "__score"])

    return docs.withColumn("__numbers", _numbers(docs, metadata)).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, metadata: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, ...) with ``__score`` (0 to 1; higher: good quality likelier) and ``__held_out``.

    Labels are learnt only from documents that are not held out (crc32 of the id as text, modulo
    FOLDS, is not HELD_FOLD); ids, and columns not named in ``metadata`` (numbers), are no input. A null text counts as
    empty and is scored like it; missing metadata counts as average; a null id is not held out and never
    learnt from. Labels that are null or neither 0 nor 1 are left out, an id with several takes the smallest;
    with labels of one class, or none, every score is near that class's share. Repeated rows score alike; no
    rows give no rows."""
    metadata = metadata or []
    model = fitted(docs, labels, metadata)
    return scored(docs, model, metadata).withColumn("__held_out", _held_out(F.col("doc_id")))


def op13_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(docs, labels, ["n_chars"]).select(
        "doc_id", F.col("__held_out").alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"),
    )
