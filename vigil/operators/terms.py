"""Corpus term statistics, vocabulary and TF-IDF weights as grouped aggregates.

A document is a row. Its terms are sorted and counted inside the row, so (document, term, tf)
needs no shuffle; corpus and document frequency are then one aggregate by term, combined
map-side over parts of PART_OCTETS of text, whose distinct terms fit a task's memory. The vocabulary is a
top-k (bounded by ``max_features``), which is why it may reach the driver and be broadcast; a document's
weights and their norm are then computed inside its row.

The vocabulary needs few of the n-grams counted: one occurs no more often than either of the two shorter
ones in it, so once ``max_features`` terms are known to occur t times, n-grams with a rarer part are out.
Lengths are counted in turn, over token arrays stored once.

Weighting of the vectoriser being matched: raw term count x (ln((1 + n) / (1 + df)) + 1),
then each document's vector scaled to unit L2 norm over the vocabulary terms it holds.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import NGRAM_RANGE, analyzed_tokens, ngram_terms
from vigil.session import ensure_checkpoint_dir

MAX_FEATURES = 10_000
PART_OCTETS = 8 << 20


def in_parts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` dealt into parts of about PART_OCTETS of text, if it has fewer."""
    octets = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0  # one row
    parts = math.ceil(octets / PART_OCTETS)
    return docs.repartition(parts) if parts > docs.rdd.getNumPartitions() else docs


def doc_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf): how often each analysed term occurs in each document."""
    docs = in_parts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")), "__text")
    toks = docs.select("doc_id", analyzed_tokens("__text").alias("__toks"))
    return count_in_rows(toks.select("doc_id", ngram_terms("__toks").alias("__terms")), "__terms")


def count_in_rows(df: DataFrame, terms_col: str) -> DataFrame:
    """One row per row of ``df`` and distinct term of its array ``terms_col``, with columns term
    and tf; null and empty arrays give none. Runs of the sorted array are counted; the arrays
    read by the lambdas are projected first (a lambda re-evaluates what it uses)."""
    keep = [c for c in df.columns if c != terms_col]
    ordered = df.select(*keep, F.sort_array(terms_col).alias("__t"))
    t, n = F.col("__t"), F.size("__t")
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 1) | (F.get(t, i - 1) != F.get(t, i - 2)))
    runs = ordered.select(*keep, "__t", starts.alias("__s"))
    ends = F.slice(F.concat(F.slice("__s", 2, F.size("__s")), F.array(n + 1)), 1, F.size("__s"))
    counted = F.zip_with(
        "__s", ends, lambda a, b: F.struct(F.get(t, a - 1).alias("term"), (b - a).cast("long").alias("tf"))
    )
    return runs.select(*keep, F.explode(counted).alias("__run")).select(*keep, "__run.term", "__run.tf")


def term_stats(pairs: DataFrame) -> DataFrame:
    """(term, tf, df): corpus frequency and document frequency per term."""
    return pairs.groupBy("term").agg(F.sum("tf").cast("long").alias("tf"), F.count(F.lit(1)).alias("df"))


def top_vocabulary(stats: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """The ``max_features`` most frequent terms; ties broken by the term text."""
    return stats.orderBy(F.col("tf").desc(), F.col("term").asc()).limit(max_features)


def _marked(array, frequent: list | None):
    """``array`` with nulls in place of terms that are not ``frequent`` (None: all are)."""
    if frequent is None:
        return F.col(array)
    quoted = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in frequent)
    return F.expr(f"transform({array}, x -> if(x IN ({quoted}), x, NULL))")


def _longer(n: int):
    """n-grams from ``__grams``, the marked (n - 1)-grams of the tokens ``__toks``; null where one of its two
    is null."""
    k = F.greatest(F.size("__toks") - F.lit(n - 1), F.lit(0))
    ends = F.zip_with(F.slice("__grams", 2, k), F.slice("__toks", n, k), lambda g, t: F.when(g.isNotNull(), t))
    return F.zip_with(F.slice("__grams", 1, k), ends, lambda g, t: F.concat(g, F.lit(" "), t))


def vocabulary_of(toks: DataFrame, max_features: int = MAX_FEATURES) -> list:
    """Rows of term, tf, df: the `top_vocabulary` of all n-grams of token arrays (column ``__toks``), one length
    after the other. Among more than ``max_features`` terms that tie at the bound nothing is left out."""
    best: list = []
    grams = toks.select("__toks", F.col("__toks").alias("__grams"))
    for n in range(1, NGRAM_RANGE[1] + 1):
        if n > 1:
            grams = grams.select("__toks", _marked("__grams", frequent).alias("__grams")).select("__toks", _longer(n).alias("__grams"))
        known = grams.select(F.filter("__grams", lambda g: g.isNotNull()).alias("__terms"))
        found = top_vocabulary(term_stats(count_in_rows(known, "__terms")), 2 * max_features).collect()  # bounded
        best = sorted([*best, *found[:max_features]], key=lambda r: (-r["tf"], r["term"]))[:max_features]
        least = best[-1]["tf"] if len(best) == max_features else 0
        open_ended = len(found) == 2 * max_features and found[-1]["tf"] >= least
        frequent = None if open_ended or least < 2 else [r["term"] for r in found if r["tf"] >= least]
    return best


def stored_words(rows: DataFrame, words_col: str) -> DataFrame:
    """The word arrays of ``rows`` (column ``__toks``), checkpointed in the partitions they have. A part stays one
    task, which reads it row by row: a scan of files would pack many parts into a task, the more the larger the
    table, and hold thousands of arrays at a time. Words hold no space, so a row is kept as one line of them."""
    ensure_checkpoint_dir(rows.sparkSession)
    lines = rows.select(F.array_join(words_col, " ").alias("__line")).checkpoint(eager=True)
    none = F.array().cast("array<string>")
    return lines.select(F.when(F.col("__line") == "", none).otherwise(F.split("__line", " ")).alias("__toks"))


def stored_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Token arrays (column ``__toks``) of all texts, kept in the shared folder."""
    parts = in_parts(docs.select(F.col(text_col).alias("__text")), "__text")
    return stored_words(parts.select(analyzed_tokens("__text").alias("__words")), "__words")


def idf(n_docs: int, df: int) -> float:
    """Smoothed inverse document frequency, plus one."""
    return math.log((1.0 + n_docs) / (1.0 + df)) + 1.0


def vector_stages(vocabulary: list, n_docs: int, terms_col: str, out_col: str, prefix: str = "__") -> list:
    """MLlib stages from an array of terms to its unit tf-idf vector over ``vocabulary`` (rows with term and
    df): a hash lookup, a product and a norm, all within the row. An empty vocabulary gives zero vectors."""
    words = [r["term"] for r in vocabulary]
    factors = [idf(n_docs, r["df"]) for r in vocabulary]
    return [
        CountVectorizerModel.from_vocabulary(words or ["__empty__"], inputCol=terms_col, outputCol=f"{prefix}tf"),
        ElementwiseProduct(scalingVec=Vectors.dense(factors or [1.0]), inputCol=f"{prefix}tf", outputCol=f"{prefix}tfidf"),
        Normalizer(p=2.0, inputCol=f"{prefix}tfidf", outputCol=out_col),
    ]


def tfidf_weights(docs: DataFrame, vocabulary: list, n_docs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, weight): each row's unit vector over the vocabulary, term by term. A document is a
    row: rows that share an id, or have none, are weighted on their own. Nothing is exchanged: the vocabulary
    (bounded by its fit) is broadcast, lookup and norm stay inside the row."""
    toks = docs.select(F.col(id_col).alias("doc_id"), analyzed_tokens(text_col).alias("__toks"))
    rows = toks.select("doc_id", F.coalesce(ngram_terms("__toks"), F.array().cast("array<string>")).alias("__terms"))
    for stage in vector_stages(vocabulary, n_docs, "__terms", "__unit"):
        rows = stage.transform(rows)
    sparse = F.unwrap_udt("__unit")
    pairs = rows.select("doc_id", F.explode(F.arrays_zip(sparse["indices"].alias("place"), sparse["values"].alias("weight"))).alias("__p"))
    names = docs.sparkSession.createDataFrame([(i, r["term"]) for i, r in enumerate(vocabulary)], "place int, term string")
    return pairs.select("doc_id", "__p.place", "__p.weight").join(F.broadcast(names), "place").select("doc_id", "term", "weight")


def fit_vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   max_features: int = MAX_FEATURES) -> tuple[list, int]:
    """(rows of term, tf, df; number of documents) of a training corpus: at most ``max_features`` rows."""
    return vocabulary_of(stored_tokens(docs, text_col), max_features), docs.count()


def vocabulary_table(docs: DataFrame, text_col: str = "text", max_features: int = MAX_FEATURES) -> DataFrame:
    """The rows of `fit_vocabulary` as a table."""
    rows = vocabulary_of(stored_tokens(docs, text_col), max_features)
    return docs.sparkSession.createDataFrame([(r["term"], r["tf"], r["df"]) for r in rows], "term string, tf long, df long")
