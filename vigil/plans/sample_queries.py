"""Sampling, splitting, hold-back and latest-window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import sampling
from vigil.plans.catalog import register
from vigil.sources import tables

SEED = 42
SAMPLE_N = 500  # rows moved to the monitoring table by the data-preparation step
WINDOW = 200  # monitoring window size

_KEY = "md5(concat('42', ':', CAST({id} AS VARCHAR)))"
_DOC_KEY = _KEY.format(id="doc_id")
_EV_KEY = _KEY.format(id="event_id")


@register(
    "exact_split",
    f"""SELECT doc_id,
  CASE WHEN row_number() OVER (ORDER BY {_DOC_KEY}, doc_id) <= ceil(0.2::DOUBLE * count(*) OVER ())
       THEN 'test' ELSE 'train' END AS split
FROM documents""",
)
def q_exact_split(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id")
    return sampling.exact_split(docs, "doc_id", 0.2, SEED)


@register(
    "exact_sample",
    f"""SELECT doc_id, lang FROM documents ORDER BY {_DOC_KEY}, doc_id LIMIT {SAMPLE_N}""",
)
def q_exact_sample(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.exact_sample(docs, "doc_id", SAMPLE_N, SEED)


@register(
    "sample_complement",
    f"""SELECT doc_id, lang FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM documents ORDER BY {_DOC_KEY}, doc_id LIMIT {SAMPLE_N})""",
)
def q_sample_complement(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.sample_complement(docs, "doc_id", SAMPLE_N, SEED)


@register(
    "latest_window",
    f"""SELECT event_id, ts, event_type FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT {WINDOW}""",
)
def q_latest_window(spark, sf_dir):
    ev = tables.table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return sampling.latest(ev, "ts", "event_id", WINDOW)


@register(
    "matched_sample",
    f"""WITH w AS (SELECT event_id FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT {WINDOW}),
r AS (SELECT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id AS review_id,
       CASE WHEN (SELECT count(*) FROM r) >= (SELECT count(*) FROM w) THEN 'ok' ELSE 'insufficient_reference' END AS status
FROM r ORDER BY {_DOC_KEY}, doc_id LIMIT (SELECT count(*) FROM w)""",
)
def q_matched_sample(spark, sf_dir):
    from vigil.plans.monitoring import matched_reference_sample

    new = tables.new_reviews(spark, sf_dir)
    ref = tables.reviews(spark, sf_dir)
    return matched_reference_sample(ref, new, WINDOW, SEED).select("review_id", "status")


@register(
    "holdback_random",
    f"""SELECT event_id,
  CASE WHEN count(*) OVER () <= {WINDOW} OR row_number() OVER (ORDER BY {_EV_KEY}, event_id) <= {WINDOW}
       THEN 'keep' ELSE 'append' END AS action
FROM events""",
)
def q_holdback_random(spark, sf_dir):
    ev = tables.table(spark, sf_dir, "events").select("event_id", "ts")
    return sampling.holdback(ev, "event_id", "ts", WINDOW, "random", SEED).select("event_id", "action")


@register(
    "holdback_latest",
    f"""SELECT event_id,
  CASE WHEN row_number() OVER (ORDER BY ts DESC NULLS LAST, event_id DESC) <= {WINDOW}
       THEN 'keep' ELSE 'append' END AS action
FROM events""",
)
def q_holdback_latest(spark, sf_dir):
    ev = tables.table(spark, sf_dir, "events").select("event_id", "ts")
    return sampling.holdback(ev, "event_id", "ts", WINDOW, "latest", SEED).select("event_id", "action")


@register(
    "example_pool",
    f"""SELECT doc_id, source FROM documents WHERE text IS NOT NULL ORDER BY {_DOC_KEY}, doc_id LIMIT 5""",
)
def q_example_pool(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return sampling.example_pool(docs, "doc_id", "text", 5, SEED).select("doc_id", "source")


@register(
    "approximate_split",
    """SELECT doc_id,
  CASE WHEN ('0x' || substr(md5(concat('42', ':', CAST(doc_id AS VARCHAR))), 1, 8))::BIGINT / 4294967296.0 < 0.2
       THEN 'test' ELSE 'train' END AS split
FROM documents""",
)
def q_approximate_split(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id")
    return sampling.approximate_split(docs, "doc_id", 0.2, SEED)




@register(
    "example_prompt",
    f"""WITH ex AS (SELECT text FROM documents WHERE text IS NOT NULL ORDER BY {_DOC_KEY}, doc_id LIMIT 5)
SELECT string_agg('- "' || text || '"', chr(10) ORDER BY text) AS examples_text, count(*) AS n_examples FROM ex""",
)
def q_example_prompt(spark, sf_dir):
    """The bulleted example list handed to the review generator (5 seeded examples)."""
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    ex = sampling.example_pool(docs, "doc_id", "text", 5, SEED)
    return ex.agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list("text")), lambda t: F.concat(F.lit('- "'), t, F.lit('"'))), "\n"
        ).alias("examples_text"),
        F.count(F.lit(1)).alias("n_examples"),
    )
