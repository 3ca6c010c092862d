"""Language ID by Bayesian evidence fusion.

The posterior of a language adds, in logarithms,

    text       naive Bayes over hashed byte trigrams of the whole text, tempered to
               ``EVIDENCE`` trigrams' worth (neighbouring trigrams are not independent)
    declared   P(declared language | language): a language tag's reliability is measured by
               grouped counts of what the texts under it look like
    suffix     P(address suffix | language), measured alike
    host       the prior of the host, smoothed towards its domain's, which is smoothed towards the
               corpus's: counts by grouped aggregation, without the row's own vote

All counts are over every row; only the trigram model is fitted on a bounded sample of
labelled documents (``MAX_TRAIN``, smallest hash of the id).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import documents, written
from vigil.llm.urlfilter import domain_of, host_of, is_address

MAX_TRAIN = 4000
BUCKETS = 1 << 16
EVIDENCE = 60.0
SMOOTH = 4.0  # pseudo-counts towards the level above
_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_DECLARED = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([^\s\"'>/]+)")
_AT_ONCE = 1 << 22  # octets scored at once


def primary(tag: str | None) -> str:
    """The primary subtag of a declared tag, in lower case: what stands before '-' or '_'; private tags
    (x-..., i-...) stay whole. Null and blank tags are empty."""
    whole = (tag or "").strip().lower()
    first = re.split("[-_]", whole)[0]
    return whole if first in ("", "i", "x") else first


def visible_text(html: str) -> str:
    import html as entities

    return entities.unescape(_HIDDEN.sub(" ", html))


def trigram_buckets(octets: np.ndarray) -> np.ndarray:
    """Hash bucket of each byte trigram (letters A-Z lower-cased)."""
    a = octets.astype(np.uint32)
    a = a + 32 * ((a >= 65) & (a <= 90)).astype(np.uint32)
    key = a[:-2] | (a[1:-1] << np.uint32(8)) | (a[2:] << np.uint32(16))
    return ((key * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def text_scores(texts: list[str], table: np.ndarray) -> np.ndarray:
    """(n, languages) tempered log-likelihoods of whole texts; fewer than three octets give zeros."""
    out = np.zeros((len(texts), table.shape[1]))
    for i, text in enumerate(texts):
        octets = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        n = len(octets) - 2
        if n < 1:
            continue
        total = np.zeros(table.shape[1])
        for at in range(0, n, _AT_ONCE):
            part = np.bincount(trigram_buckets(octets[at:at + _AT_ONCE + 2]), minlength=BUCKETS) if n > 20_000 else None
            if part is None:
                total += table[trigram_buckets(octets)].sum(axis=0)
            else:
                total += part @ table
        out[i] = total * min(1.0, EVIDENCE / n)
    return out


def _score_partition(languages: list[str], table: np.ndarray):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, declared = [], []
            for text, html, said in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if html is not None:
                    found = _DECLARED.search(html)
                    said = found.group(1) if found else said
                    text = visible_text(html)
                texts.append(text or "")
                declared.append(primary(said))
            scores = text_scores(texts, table)
            best = scores.argmax(axis=1)  # ties: the first language by name
            # without three octets of text there is no vote
            voted = [languages[b] if len(t) > 2 else None for b, t in zip(best, texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(scores.tolist(), pa.list_(pa.float64())),
                    pa.array(voted, pa.string()), pa.array(declared, pa.string()),
                    batch.column(5), batch.column(6), batch.column(7),
                ],
                ["doc_id", "page_id", "scores", "vote", "declared", "suffix", "domain", "host"],
            )

    return run


def _counts(votes: DataFrame, key: str, languages: list[str]) -> DataFrame:
    """Votes by key: an array of counts in the order of ``languages``, map-side combined."""
    sums = [F.sum((F.col("vote") == v).cast("double")).alias(f"n{i}") for i, v in enumerate(languages)]
    grouped = votes.filter("vote IS NOT NULL").groupBy(F.col(key).alias(f"__{key}")).agg(*sums)
    return grouped.select(f"__{key}", F.array(*[f"n{i}" for i in range(len(languages))]).alias(f"by_{key}"))


def _array(values: list[Column]) -> Column:
    return F.array(*values)


def identify(rows: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """rows (doc_id, page_id, text, html, declared, suffix, domain, host) -> doc_id, page_id,
    lang, probability, text_lang, declared; one row per row. html takes precedence over text
    and its <html lang> over declared; declared comes back as its primary subtag. Null or empty text leaves the other evidence to decide;
    a null or unseen declared tag, suffix, domain or host adds nothing; repeated rows are judged
    alike; no rows give no rows; no trained language gives a null lang."""
    if not languages:
        return rows.select(
            "doc_id", "page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"),
            F.lit(None).cast("string").alias("text_lang"), F.col("declared").cast("string").alias("declared"),
        )
    k = len(languages)
    columns = ["doc_id", "page_id", "text", "html", "declared", "suffix", "domain", "host"]
    schema = (
        "doc_id long, page_id long, scores array<double>, vote string, declared string, suffix string, domain string, host string"
    )
    scored = written(rows.select(columns).mapInArrow(_score_partition(languages, table), schema), "language-scores")
    total = scored.filter("vote IS NOT NULL").agg(
        *[F.coalesce(F.sum((F.col("vote") == v).cast("double")), F.lit(0.0)) for v in languages]
    ).first()
    corpus = [(n + 1.0) / (sum(total) + k) for n in total]
    out = scored
    for key in ("declared", "suffix", "domain", "host"):
        by = _counts(scored.filter(f"{key} IS NOT NULL AND {key} <> ''"), key, languages)
        out = out.join(by, out[key] == by[f"__{key}"], "left").drop(f"__{key}")

    own = [F.coalesce((F.col("vote") == v).cast("double"), F.lit(0.0)) for v in languages]

    def seen(key: str, i: int) -> Column:  # others' votes under the row's key
        return F.greatest(F.coalesce(F.col(f"by_{key}")[i] - own[i], F.lit(0.0)), F.lit(0.0))

    posterior = []
    for i in range(k):
        parts = F.col("scores")[i]
        for key in ("declared", "suffix"):
            of_key = sum((seen(key, j) for j in range(k)), F.lit(0.0))
            # P(key | language) up to P(key): how the key's texts differ from the corpus
            parts = parts + F.log((seen(key, i) + SMOOTH * corpus[i]) / (of_key + SMOOTH)) - F.log(F.lit(corpus[i]))
        domain = (seen("domain", i) + SMOOTH * corpus[i]) / (sum((seen("domain", j) for j in range(k)), F.lit(0.0)) + SMOOTH)
        host = (seen("host", i) + SMOOTH * domain) / (sum((seen("host", j) for j in range(k)), F.lit(0.0)) + SMOOTH)
        posterior.append(parts + F.log(host))
    out = out.withColumn("__post", _array(posterior))
    best = F.array_max("__post")
    share = 1 / F.aggregate("__post", F.lit(0.0), lambda s, x: s + F.exp(x - best))
    names = _array([F.lit(v) for v in languages])
    return out.select(
        "doc_id", "page_id", F.element_at(names, F.array_position("__post", best).cast("int")).alias("lang"),
        share.alias("probability"), F.col("vote").alias("text_lang"), "declared",
    )


def fit(docs: DataFrame, limit: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """The trigram model of at most ``limit`` documents that name a language (doc_id, text, lang). A language is
    the primary subtag: ``en``, ``EN`` and ``en-US`` are one, named ``en``. Only ids are ordered; the texts of the chosen ones are fetched by a semi-join."""
    chosen = (
        docs.filter("lang IS NOT NULL AND lang <> '' AND text IS NOT NULL AND doc_id IS NOT NULL")
        .select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    # at most `limit` ids: safe to broadcast; trigram counts are summed in Spark, by language
    texts = docs.join(F.broadcast(chosen), "doc_id", "left_semi").filter("lang IS NOT NULL AND lang <> '' AND text IS NOT NULL")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lang = primary(tag)
                if not lang:  # a blank tag
                    continue
                octets = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                if len(octets) > 2:
                    sums[lang] += np.bincount(trigram_buckets(octets), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"]
            )

    table = (
        texts.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most languages x BUCKETS rows
    )
    languages = sorted(table["lang"].unique())
    counts = np.full((len(languages), BUCKETS), 0.5)
    for i, lang in enumerate(languages):
        part = table[table["lang"] == lang]
        counts[i, part["bucket"].to_numpy()] += part["n"].to_numpy()
    if not languages:
        return [], np.zeros((BUCKETS, 0), np.float32)
    return list(languages), np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()


def op7_language(spark, sf_dir: str) -> DataFrame:
    """All documents (declared: lang; host: source) and all pages (declared: <html lang>; suffix,
    domain and host of the address). Documents have a null page_id and the other way round."""
    docs = documents(spark, sf_dir)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    none = lambda kind="string": F.lit(None).cast(kind)
    host = host_of(F.col("url"))
    rows = docs.select(
        "doc_id", none("long").alias("page_id"), "text", none().alias("html"), F.col("lang").alias("declared"),
        none().alias("suffix"), none().alias("domain"), F.col("source").alias("host"),
    ).unionByName(
        pages.select(
            none("long").alias("doc_id"), "page_id", none().alias("text"), F.coalesce("html", F.lit("")).alias("html"),
            none().alias("declared"), F.when(is_address(host), "").otherwise(F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"),
            domain_of(host).alias("domain"), host.alias("host"),
        )
    )
    return identify(rows, *fit(docs))
