"""Text queries: cleaning, tokens, n-grams, term statistics, vocabulary, TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import text as tx
from vigil.operators import terms
from vigil.plans.catalog import register, rounded
from vigil.sources import tables


def _re(p: str) -> str:
    return p.replace("'", "''")


_CLEAN = (
    "trim(regexp_replace(lower(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    f"text, '{_re(tx.URL_PATTERN)}', '', 'g'), '{tx.HTTP_PATTERN}', '', 'g'), '{_re(tx.HANDLE_PATTERN)}', '', 'g'), "
    f"'{_re(tx.KEEP_CLASS)}', ' ', 'g'), '@', ' at ')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
)


def _stop_list() -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in tx.default_stop_words()) + "]"


def _terms_sql() -> str:
    return f"""c AS (SELECT doc_id, {_CLEAN} AS cleaned FROM documents),
tk AS (SELECT doc_id, regexp_extract_all(cleaned, '{tx.TOKEN_PATTERN}') AS toks FROM c),
sw AS (SELECT doc_id, list_filter(toks, lambda x: NOT list_contains({_stop_list()}, x)) AS t FROM tk),
ng AS (SELECT doc_id, t,
         list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS bi,
         list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) AS tri FROM sw),
pairs AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(t, bi, tri)) AS term FROM ng)
          GROUP BY doc_id, term),
stats AS (SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM pairs GROUP BY term)"""


@register("clean_text", f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents")
def q_clean_text(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", tx.clean_text("text").alias("cleaned"))


@register(
    "token_counts",
    f"""WITH c AS (SELECT {_CLEAN} AS cleaned FROM documents)
SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(cleaned, '{tx.TOKEN_PATTERN}')) AS token FROM c)
GROUP BY token""",
)
def q_token_counts(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("text")
    toks = docs.select(F.explode(tx.tokens(tx.clean_text("text"))).alias("token"))
    return toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@register(
    "ngram_counts",
    f"""WITH {_terms_sql()}
SELECT doc_id, len(t)::BIGINT AS unigrams, len(bi)::BIGINT AS bigrams, len(tri)::BIGINT AS trigrams FROM ng""",
)
def q_ngram_counts(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    t = tx.remove_stop_words(tx.tokens(tx.clean_text("text")))
    return docs.select("doc_id", t.alias("t")).select(
        "doc_id",
        F.size(tx.ngrams("t", 1)).cast("bigint").alias("unigrams"),
        F.size(tx.ngrams("t", 2)).cast("bigint").alias("bigrams"),
        F.size(tx.ngrams("t", 3)).cast("bigint").alias("trigrams"),
    )


@register("term_stats", f"WITH {_terms_sql()} SELECT term, tf, df FROM stats")
def q_term_stats(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return terms.term_stats(terms.doc_terms(docs))


@register(
    "top_vocabulary",
    f"WITH {_terms_sql()} SELECT term, tf, df FROM stats ORDER BY tf DESC, term ASC LIMIT {terms.MAX_FEATURES}",
)
def q_top_vocabulary(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return terms.vocabulary_table(docs)


@register(
    "tfidf_weights",
    f"""WITH {_terms_sql()},
vocab AS (SELECT term, df FROM stats ORDER BY tf DESC, term ASC LIMIT {terms.MAX_FEATURES}),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM vocab),
w AS (SELECT doc_id, term, tf * idf AS raw FROM pairs JOIN idf USING (term)),
n AS (SELECT doc_id, sqrt(sum(raw * raw)) AS nrm FROM w GROUP BY doc_id)
SELECT doc_id, term, round(CASE WHEN nrm > 0 THEN raw / nrm END, 6) AS weight FROM w JOIN n USING (doc_id)""",
)
def q_tfidf_weights(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary, n_docs = terms.fit_vocabulary(docs)
    return rounded(terms.tfidf_weights(docs, vocabulary, n_docs))


_WORDS = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))"


@register(
    "text_lengths",
    f"SELECT doc_id, length(text)::BIGINT AS n_chars, {_WORDS}::BIGINT AS n_words FROM documents",
)
def q_text_lengths(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select(
        "doc_id", tx.char_length("text").cast("bigint").alias("n_chars"), tx.word_count("text").cast("bigint").alias("n_words")
    )
