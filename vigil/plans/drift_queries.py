"""Drift queries: moments, distances, similarities, KS and the combined drift row."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import drift
from vigil.operators.ks import ks_by_flag
from vigil.plans.catalog import register, rounded
from vigil.session import scratch_path
from vigil.sources import tables
from vigil.sources.commits import CommitLog
from vigil.sources.per_file import Moments

# DuckDB fragments shared by the SQL twins.
_E = """e AS (SELECT vec_id, embedding, CASE WHEN label < 4 THEN 'ref' ELSE 'new' END AS grp FROM embeddings)"""
_X = """x AS (SELECT grp, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM e)"""
_M = """m AS (SELECT grp, pos, avg(x) AS mean, stddev_pop(x) AS std FROM x GROUP BY grp, pos)"""
_C = """c AS (SELECT list(mean ORDER BY pos) AS centroid FROM m WHERE grp = 'ref')"""
_S = """s AS (
  SELECT e.vec_id, e.grp,
    CASE WHEN sqrt(list_reduce(list_transform(e.embedding, lambda t: t::DOUBLE * t::DOUBLE), lambda a, b: a + b))
              * sqrt(list_reduce(list_transform(c.centroid, lambda t: t * t), lambda a, b: a + b)) > 0
         THEN list_reduce(list_transform(list_zip(e.embedding, c.centroid), lambda t: t[1]::DOUBLE * t[2]), lambda a, b: a + b)
              / (sqrt(list_reduce(list_transform(e.embedding, lambda t: t::DOUBLE * t::DOUBLE), lambda a, b: a + b))
                 * sqrt(list_reduce(list_transform(c.centroid, lambda t: t * t), lambda a, b: a + b)))
    END AS similarity
  FROM e CROSS JOIN c)"""
_D = """d AS (
  SELECT sqrt(coalesce(sum(pow(r.mean - n.mean, 2)), 0)) AS centroid_distance,
         sqrt(coalesce(sum(pow(r.std - n.std, 2)), 0)) AS spread_distance
  FROM m r JOIN m n ON r.pos = n.pos AND r.grp = 'ref' AND n.grp = 'new')"""


def _ks_sql(source: str, value: str, is_a: str) -> str:
    """KS CTEs over ``source`` (already defined), returning ks_stat, n_a, n_b."""
    return f"""g AS (
  SELECT {value} AS v, count(*) FILTER (WHERE {is_a}) AS ca, count(*) FILTER (WHERE NOT ({is_a})) AS cb
  FROM {source} WHERE {value} IS NOT NULL AND NOT isnan({value}) GROUP BY {value}),
cum AS (
  SELECT sum(ca) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_a,
         sum(cb) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_b,
         sum(ca) OVER () AS na, sum(cb) OVER () AS nb
  FROM g),
k AS (
  SELECT coalesce(max(abs(cum_a / na - cum_b / nb)), 0.0) AS gap,
         coalesce(max(na), 0)::BIGINT AS n_a, coalesce(max(nb), 0)::BIGINT AS n_b FROM cum)"""


_KS_OUT = """SELECT round(CASE WHEN n_a > 0 AND n_b > 0 THEN gap ELSE 0.0 END, 6) AS ks_stat, n_a, n_b,
       CASE WHEN n_a > 0 AND n_b > 0 THEN 'ok' ELSE 'no_data' END AS status FROM k"""


@register(
    "embedding_drift",
    f"""WITH {_E}, {_X}, {_M}, {_C}, {_S}, {_D},
{_ks_sql("s", "similarity", "grp = 'ref'")},
n AS (SELECT count(*) FILTER (WHERE grp = 'ref') AS n_ref, count(*) FILTER (WHERE grp = 'new') AS n_new FROM e)
SELECT round(k.gap, 6) AS semantic_ks,
       round(d.centroid_distance, 6) AS centroid_distance,
       round(d.spread_distance, 6) AS spread_distance,
       round(0.5 * k.gap + 0.3 * least(d.centroid_distance / 10.0, 1.0) + 0.2 * least(d.spread_distance / 5.0, 1.0), 6)
         AS combined_drift_score,
       n.n_ref, n.n_new, 'ok' AS status
FROM k, d, n""",
)
def q_embedding_drift(spark, sf_dir):
    return rounded(drift.embedding_drift(tables.embeddings(spark, sf_dir)))


@register(
    "embedding_centroid",
    f"""WITH {_E}, {_X}, {_M} SELECT grp, pos, round(mean, 6) AS centroid_value FROM m""",
)
def q_embedding_centroid(spark, sf_dir):
    m = drift.dimension_moments(tables.embeddings(spark, sf_dir))
    return rounded(m.select("grp", F.col("pos").cast("bigint").alias("pos"), F.col("mean").alias("centroid_value")))


@register(
    "embedding_spread",
    f"""WITH {_E}, {_X}, {_M} SELECT grp, pos, round(std, 6) AS spread_value FROM m""",
)
def q_embedding_spread(spark, sf_dir):
    m = drift.dimension_moments(tables.embeddings(spark, sf_dir))
    return rounded(m.select("grp", F.col("pos").cast("bigint").alias("pos"), F.col("std").alias("spread_value")))


@register(
    "stored_moments",
    f"""WITH {_E}, {_X}, {_M}
SELECT grp, pos, round(mean, 6) AS mean, round(std, 6) AS std,
       (SELECT count(*) FROM x WHERE x.grp = m.grp AND x.pos = m.pos) AS n FROM m""",
)
def q_stored_moments(spark, sf_dir):
    """Moments merged from those of files that arrived one after the other, each read once."""
    emb = tables.embeddings(spark, sf_dir)
    folder = scratch_path(spark, "embedding-files")
    store = Moments(CommitLog(spark, scratch_path(spark, "moments"), {}), lambda rows: rows.select("path", "grp", "embedding"))
    for k in range(2):
        emb.filter(F.col("vec_id") % 2 == k).coalesce(1).write.mode("append").parquet(folder)
        store.update(folder)
    return rounded(store.merged(folder).withColumn("pos", F.col("pos").cast("bigint")))


@register(
    "centroid_distance",
    f"""WITH {_E}, {_X}, {_M}, {_D} SELECT round(centroid_distance, 6) AS centroid_distance FROM d""",
)
def q_centroid_distance(spark, sf_dir):
    m = drift.dimension_moments(tables.embeddings(spark, sf_dir))
    return rounded(drift.moment_distances(m).select("centroid_distance"))


@register(
    "spread_distance",
    f"""WITH {_E}, {_X}, {_M}, {_D} SELECT round(spread_distance, 6) AS spread_distance FROM d""",
)
def q_spread_distance(spark, sf_dir):
    m = drift.dimension_moments(tables.embeddings(spark, sf_dir))
    return rounded(drift.moment_distances(m).select("spread_distance"))


@register(
    "cosine_to_centroid",
    f"""WITH {_E}, {_X}, {_M}, {_C}, {_S} SELECT vec_id, grp, round(similarity, 6) AS similarity FROM s""",
)
def q_cosine_to_centroid(spark, sf_dir):
    emb = tables.embeddings(spark, sf_dir)
    centroid = drift.group_vectors(drift.dimension_moments(emb)).filter(F.col("grp") == "ref")
    sims = drift.similarity_to_centroid(emb, centroid)
    return rounded(sims.select("vec_id", "grp", "similarity"))


@register(
    "semantic_ks",
    f"""WITH {_E}, {_X}, {_M}, {_C}, {_S}, {_ks_sql("s", "similarity", "grp = 'ref'")} {_KS_OUT}""",
)
def q_semantic_ks(spark, sf_dir):
    emb = tables.embeddings(spark, sf_dir)
    centroid = drift.group_vectors(drift.dimension_moments(emb)).filter(F.col("grp") == "ref")
    sims = drift.similarity_to_centroid(emb, centroid)
    return rounded(ks_by_flag(sims, "similarity", F.col("grp") == "ref"))


@register(
    "ks_two_sample",
    f"""WITH li AS (SELECT l_extendedprice, l_returnflag = 'R' AS is_a FROM lineitem),
{_ks_sql("li", "l_extendedprice", "is_a")} {_KS_OUT}""",
)
def q_ks_two_sample(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_returnflag")
    return rounded(ks_by_flag(li, "l_extendedprice", F.col("l_returnflag") == "R"))
