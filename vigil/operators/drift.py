"""Embedding drift between a reference group and a new group of vectors.

Per-dimension moments come from ``posexplode`` + ``groupBy(grp, pos)``: the aggregate is
partial on the map side, so the shuffle carries (groups x width) rows per task no matter
how many vectors there are, and a hot group costs nothing extra. Each vector's cosine
similarity to the reference centroid is computed against a one-row broadcast centroid.
The KS statistic between the two similarity samples uses the bucketed running totals.

Combined score (fixed weights and scales of the monitored system):
  0.5 * ks + 0.3 * min(centroid_distance / 10, 1) + 0.2 * min(spread_distance / 5, 1)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.vectors import cosine
from vigil.operators.cumulative import settled
from vigil.operators.ks import ks_by_flag

# Fixed values of the monitored system's combined drift score.
KS_WEIGHT, CENTROID_WEIGHT, SPREAD_WEIGHT = 0.5, 0.3, 0.2
CENTROID_SCALE, SPREAD_SCALE = 10.0, 5.0


def dimension_moments(emb: DataFrame, vec_col: str = "embedding", grp_col: str = "grp",
                      method: str = "explode") -> DataFrame:
    """(grp, pos, mean, std, n): per-dimension mean and population std (ddof 0).

    ``method='explode'`` aggregates (grp, pos) rows with partial aggregation (best for
    the usual widths); ``method='summarizer'`` folds whole vectors with MLlib's
    Summarizer (one buffer per group and task, for very wide vectors)."""
    if method == "summarizer":
        return _summarizer_moments(emb, vec_col, grp_col)
    named = emb.select(F.col(grp_col).alias("grp"), F.col(vec_col).alias("embedding"))
    return finished_moments(moment_parts(named, ["grp"]), ["grp"])


PART_FIELDS = [
    T.StructField("pos", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType()),
    T.StructField("m2", T.DoubleType()), T.StructField("n_rows", T.LongType()),
]


def moment_parts(emb: DataFrame, by: list[str]) -> DataFrame:
    """(by.., pos, n, mean, m2, n_rows) of the vectors in ``embedding``: count, mean and sum of squared deviations
    of each dimension, to be merged later. ``n_rows`` counts vectors, at their first dimension; vectors
    that are null or empty are one row at a null ``pos``."""
    x = F.col("x").cast("double")
    exploded = emb.select(*by, F.posexplode_outer("embedding").alias("pos", "x"))
    return exploded.groupBy(*by, "pos").agg(
        F.count("x").alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count("x")).alias("m2"),
        F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("n_rows"),
    )


def finished_moments(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by.., pos, mean, std, n) of complete parts: population standard deviation."""
    return parts.filter(F.col("pos").isNotNull()).select(
        *by, "pos", "mean", F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / F.col("n")).alias("std"), "n"
    )


def merged_moments(parts: DataFrame, by: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Moments of all rows from the parts of disjoint sets of them: the deviations within the parts, plus those of their
    means from the common mean. Parts are few (sets x width), so merging costs no pass over vectors."""
    keys = [*by, "pos"]
    parts = parts.filter(F.col("pos").isNotNull())
    common = parts.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("__mean"))
    apart = F.col("n") * F.pow(F.col("mean") - F.col("__mean"), 2)
    whole = parts.join(common, keys).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("__mean").alias("mean"), F.sum(F.col("m2") + F.coalesce(apart, F.lit(0.0))).alias("m2")
    )
    return finished_moments(whole, list(by))


def _summarizer_moments(emb: DataFrame, vec_col: str, grp_col: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    vecs = emb.select(
        F.col(grp_col).alias("grp"), array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))).alias("v")
    )
    summ = vecs.groupBy("grp").agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s"))
    n = F.col("s.count")
    # Summarizer's variance is the sample variance; the population one scales by (n-1)/n.
    pop_var = F.transform(
        vector_to_array(F.col("s.variance")), lambda v: v * (n - F.lit(1)) / n
    )
    flat = summ.select(
        "grp", n.alias("n"),
        F.arrays_zip(vector_to_array(F.col("s.mean")).alias("mean"), pop_var.alias("var")).alias("z"),
    )
    return flat.select("grp", "n", F.posexplode("z").alias("pos", "m")).select(
        "grp", "pos", F.col("m.mean").alias("mean"), F.sqrt(F.greatest(F.col("m.var"), F.lit(0.0))).alias("std"), "n"
    )


def group_vectors(moments: DataFrame) -> DataFrame:
    """(grp, centroid ARRAY<DOUBLE>, spread ARRAY<DOUBLE>): one row per group, width-bounded."""
    packed = moments.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("m"))
    return packed.select(
        "grp",
        F.transform("m", lambda s: s["mean"]).alias("centroid"),
        F.transform("m", lambda s: s["std"]).alias("spread"),
    )


def moment_distances(moments: DataFrame, ref: str = "ref", new: str = "new") -> DataFrame:
    """One row: centroid_distance, spread_distance (Euclidean). Groups of unequal width are an error;
    a group without rows gives 0.0."""
    r = moments.filter(F.col("grp") == ref).select(
        F.col("pos").alias("rpos"), F.col("mean").alias("rm"), F.col("std").alias("rs")
    )
    n = moments.filter(F.col("grp") == new).select(
        F.col("pos").alias("npos"), F.col("mean").alias("nm"), F.col("std").alias("ns")
    )
    sums = r.join(n, F.col("rpos") == F.col("npos"), "full").agg(
        F.coalesce(F.sum(F.pow(F.col("rm") - F.col("nm"), 2)), F.lit(0.0)).alias("means"),
        F.coalesce(F.sum(F.pow(F.col("rs") - F.col("ns"), 2)), F.lit(0.0)).alias("stds"),
        F.count("rpos").alias("r"),
        F.count("npos").alias("n"),
        F.count_if(F.col("rpos").isNull() | F.col("npos").isNull()).alias("alone"),
    )
    wrong = F.raise_error(F.lit("groups of unequal width")).cast("double")
    unequal = (F.col("r") > 0) & (F.col("n") > 0) & (F.col("alone") > 0)
    return sums.select(
        F.when(unequal, wrong).otherwise(F.sqrt("means")).alias("centroid_distance"),
        F.when(unequal, wrong).otherwise(F.sqrt("stds")).alias("spread_distance"),
    )


def similarity_to_centroid(
    emb: DataFrame, centroid: DataFrame, vec_col: str = "embedding", out_col: str = "similarity"
) -> DataFrame:
    """Cosine similarity of every vector to a one-row centroid (broadcast: one vector)."""
    c = centroid.select(F.col("centroid").alias("__centroid"))
    return emb.crossJoin(F.broadcast(c)).withColumn(out_col, cosine(vec_col, "__centroid")).drop("__centroid")


def embedding_drift(
    emb: DataFrame,
    vec_col: str = "embedding",
    grp_col: str = "grp",
    ref: str = "ref",
    new: str = "new",
    num_buckets: int | None = None,
    moments_method: str = "explode",
) -> DataFrame:
    """One row: semantic_ks, centroid_distance, spread_distance, combined_drift_score,
    n_ref, n_new, status ('ok' | 'no_data'; all metrics 0.0 when a side is empty)."""
    emb = emb.select(F.col(vec_col).alias("embedding"), F.col(grp_col).alias("grp")).filter(
        F.col("grp").isin(ref, new)
    )
    # One pass for moments and counts (groups x width rows, written once), one for the similarities.
    if moments_method == "summarizer":
        moments = dimension_moments(emb, method=moments_method)
        rows = emb.groupBy("grp").agg(F.count(F.lit(1)).alias("n_rows"))
    else:
        parts = settled(moment_parts(emb, ["grp"]))
        moments, rows = finished_moments(parts, ["grp"]), parts
    vectors = group_vectors(moments)
    dist = moment_distances(moments, ref, new)
    sims = similarity_to_centroid(emb, vectors.filter(F.col("grp") == ref))
    ks = ks_by_flag(sims, "similarity", F.col("grp") == ref, num_buckets=num_buckets)
    counts = rows.agg(*[
        F.coalesce(F.sum(F.when(F.col("grp") == g, F.col("n_rows"))), F.lit(0)).alias(c) for g, c in ((ref, "n_ref"), (new, "n_new"))
    ])
    ok = (F.col("n_ref") > 0) & (F.col("n_new") > 0)
    zero = F.lit(0.0)
    cd = F.coalesce(F.col("centroid_distance"), zero)
    sd = F.coalesce(F.col("spread_distance"), zero)
    combined = (
        F.lit(KS_WEIGHT) * F.col("ks_stat")
        + F.lit(CENTROID_WEIGHT) * F.least(cd / F.lit(CENTROID_SCALE), F.lit(1.0))
        + F.lit(SPREAD_WEIGHT) * F.least(sd / F.lit(SPREAD_SCALE), F.lit(1.0))
    )
    # All three inputs are one-row aggregates.
    return (
        counts.crossJoin(ks.select("ks_stat"))
        .crossJoin(dist)
        .select(
            F.when(ok, F.col("ks_stat")).otherwise(zero).alias("semantic_ks"),
            F.when(ok, cd).otherwise(zero).alias("centroid_distance"),
            F.when(ok, sd).otherwise(zero).alias("spread_distance"),
            F.when(ok, combined).otherwise(zero).alias("combined_drift_score"),
            "n_ref",
            "n_new",
            F.when(ok, F.lit("ok")).otherwise(F.lit("no_data")).alias("status"),
        )
    )
