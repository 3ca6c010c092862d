"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sources, in code point order (null last), weigh 5, 2, 1, repeating, and share ``share`` of all
words. A target stops at ``most`` times its source's size and its excess goes to the others by
weight until none is above (computed in closed form over the table of sources).

A document of a source with target T and size S is due T / S copies: its whole part is
certain; the fraction is its inclusion probability p for one copy more. Documents are ranked
by random odds over inclusion odds, u/(1-u) / (p/(1-p)), and taken in that order while their
words fit what the source still lacks. The document at the cut does not fit; up to
``PASSES`` passes go on behind it with those that do, so what lacks in the end is less than
a small document.

The cut is found without sorting a source: words per cell of the rank (CELLS cells), running
sums over cells, and only the rows of the one cell in which the sum is reached are ranked
one by one.

Rows are never moved by source, of which one may hold a third of them all: tables with a row per source are
broadcast if their number of rows is checked to be within ``BROADCAST_SOURCES``; beyond it, rows are salted by their id
and text and the sources, far fewer, repeated per salt. Both give the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import WORD_PATTERN, documents, written

WEIGHTS = (5, 2, 1)
SHARE = 1.0
MOST = 3
PASSES = 3
CELLS = 4096
SEED = 17
BROADCAST_SOURCES = 100_000  # rows of some 50 octets
SALTS = 64


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> source, k (rank), source_size, target. One row per source goes
    through one window; the table has as many rows as there are sources."""
    everything = Window.partitionBy()
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    turn = F.pmod(F.col("k") - 1, F.lit(len(weights)))
    weight = F.coalesce(*[F.when(turn == i, F.lit(float(w))) for i, w in enumerate(weights)])
    ranked = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ranked = ranked.withColumn("level", F.col("cap") / F.col("w"))
    upto = Window.orderBy("level", "k").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("level", "k").rowsBetween(0, Window.unboundedFollowing)
    filled = ranked.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("total"),
        F.coalesce(F.sum("cap").over(upto), F.lit(0.0)).alias("cap_before"),
        F.sum("w").over(onward).alias("w_onward"),
    ).withColumn("water", (F.col("total") - F.col("cap_before")) / F.col("w_onward"))
    # sources below the first whose cap holds the water stand at their caps; from there on the
    # water would only sink, so it is the highest that its own cap holds
    line = F.max(F.when(F.col("water") <= F.col("level"), F.col("water"))).over(
        Window.orderBy("level", "k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return filled.select(
        "source", "k", "source_size",
        F.when(line.isNull(), F.col("cap")).otherwise(F.least("cap", line * F.col("w"))).alias("target"),
    )


def uniform(doc_id: Column, text_hash: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) from the id and the text's MD5: the same in every run and order."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), text_hash, F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def _attached(items: DataFrame, by_source: DataFrame, few: bool, key: str = "k", how: str = "inner") -> DataFrame:
    """``items`` with the columns of a table that has one row per source; ``few``: its size was checked."""
    right = by_source.withColumnRenamed(key, "__of")
    same = F.col(key).eqNullSafe(F.col("__of"))
    if few:
        return items.join(F.broadcast(right), same, how).drop("__of")
    right = right.withColumn("__slot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = items.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int"))
    return salted.join(right, same & (F.col("__salt") == F.col("__slot")), how).drop("__of", "__salt", "__slot")


def _one_pass(items: DataFrame, gaps: DataFrame, few: bool) -> DataFrame:
    """items (.., k, cell, rank, size, n, extra) -> the same, with ``extra`` (of an item's n equal
    rows) raised by what this pass takes of each source's gap."""
    open_items = _attached(items, gaps, few).withColumn("words", F.col("size") * (F.col("n") - F.col("extra")))
    fits = (F.col("rank").isNotNull()) & (F.col("words") > 0) & (F.col("size") <= F.col("gap"))
    flagged = open_items.withColumn("fits", F.coalesce(fits, F.lit(False)))
    cells = flagged.filter("fits").groupBy("k", "cell", "gap").agg(F.sum("words").alias("words"))
    running = F.sum("words").over(Window.partitionBy("k").orderBy("cell"))
    cut = (
        cells.withColumn("upto", running)
        .filter(F.col("upto") > F.col("gap"))
        .groupBy("k")
        .agg(F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("before"))).alias("at"))
        .select("k", F.col("at.cell").alias("cut_cell"), F.col("at.before").alias("before"))
    )
    placed = _attached(flagged, cut, few, how="left")
    whole = F.col("fits") & (F.col("cut_cell").isNull() | (F.col("cell") < F.col("cut_cell")))
    edge = F.coalesce(F.col("fits") & (F.col("cell") == F.col("cut_cell")), F.lit(False))
    columns = items.columns
    order = Window.partitionBy("k").orderBy("rank", F.col("doc_id").asc_nulls_last(), "text_hash")
    at_edge = placed.filter(edge).withColumn("upto", F.col("before") + F.sum("words").over(order))
    # whole numbers of words: of the item at the cut, as many rows as there is room for
    room = F.expr("greatest(0L, least(n - extra, (cast(floor(gap) AS long) - (upto - words)) div size))")
    at_edge = at_edge.withColumn("extra", F.col("extra") + room)
    others = placed.filter(~edge).withColumn("extra", F.when(whole, F.col("n")).otherwise(F.col("extra")))
    return others.select(columns).unionByName(at_edge.select(columns))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Plan a mix of ``docs`` (doc_id, text, source): one row per distinct (doc_id, text, source)
    with text_hash (MD5; empty text for null), size, source_size, target, copies (0 to ``most``) that
    each of its rows gets, and more: how many of its equal rows get one copy beyond that.

    A text without words (null, empty) has size 0 and is never taken; a source without words has
    target 0; rows that repeat id, text and source are one row here, of one rank, and are taken
    one by one; a null id is an id of its own; no rows give no rows. Taken words never exceed the target."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.md5(text).alias("text_hash"), F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"),
    )
    rows = written(
        sized.groupBy("doc_id", "source", "text_hash").agg(F.first("size").alias("size"), F.count("*").alias("n")),
        "mix-items",
    )
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = written(source_targets(totals, weights, share, most), "mix-sources")
    few = targets.count() <= BROADCAST_SOURCES
    u = uniform(F.col("doc_id"), F.col("text_hash"), seed)
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    items = (
        _attached(rows, targets, few, "source")
        .select("doc_id", "source", "text_hash", "size", "n", "k", "source_size", "target",
                F.floor(due).alias("certain"), (due - F.floor(due)).alias("p"), u.alias("u"))
        .withColumn("odds", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
        .withColumn("rank", F.col("odds") / (1 + F.col("odds")))
        .withColumn("cell", F.floor(F.col("rank") * CELLS))
        .withColumn("extra", F.lit(0).cast("long"))
        .drop("odds", "u")
    )
    full = F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")
    gaps = targets.select("k", F.when(F.col("source_size") > 0, full).otherwise(0.0).alias("gap"))
    for _ in range(PASSES):
        items = written(_one_pass(items, gaps, few), "mix-pass")
        taken = items.groupBy("k").agg(F.sum(F.col("size") * F.col("extra")).alias("got"))
        gaps = targets.join(taken, "k").select(
            "k", F.when(F.col("source_size") > 0, full - F.col("got")).otherwise(0.0).alias("gap")
        )
    return items.select(
        "doc_id", "source", "text_hash", "size", "source_size", "target",
        (F.col("certain") + (F.col("extra") == F.col("n")).cast("int")).cast("int").alias("copies"),
        F.when(F.col("extra") < F.col("n"), F.col("extra")).otherwise(0).alias("more"),
    )


def _rows_with_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Every row of ``docs`` with the plan of its id, text and source, as ``__plan``."""
    out = _joined(docs, plan.filter("more = 0"))
    parted = plan.filter("more > 0")  # at most one item of a source in each pass
    if parted.isEmpty():
        return out
    # equal rows by number: by partition first, then within each, so that no task holds them all
    placed = docs.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    rows = written(_joined(placed, parted).withColumn("__unit", F.struct("__plan.doc_id", "__plan.source", "__plan.text_hash")), "mix-equal")
    counts = rows.groupBy(F.col("__unit").alias("__u"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy("__u").orderBy("__p")) - F.col("__n")
    numbered = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__unit", "__part").orderBy("__at"))).join(
        counts.withColumn("__earlier", earlier), F.col("__unit").eqNullSafe(F.col("__u")) & (F.col("__part") == F.col("__p"))
    )
    one_more = (F.col("__earlier") + F.col("__nth") <= F.col("__plan.more")).cast("int")
    plan_of_row = F.col("__plan").withField("copies", F.col("__plan.copies") + one_more)
    return out.unionByName(numbered.withColumn("__plan", plan_of_row).select(*out.columns))


def _joined(docs: DataFrame, plan: DataFrame) -> DataFrame:
    planned = plan.select(
        F.struct("doc_id", "source", "text_hash").alias("__key"),
        F.struct("size", "source_size", "target", "copies", "more", "doc_id", "source", "text_hash").alias("__plan"),
    )
    key = F.struct(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"),
    )
    left = docs.withColumn("__row", key)
    same = F.col("__row.text_hash") == F.col("__key.text_hash")
    same &= F.col("__row.doc_id").eqNullSafe(F.col("__key.doc_id"))
    same &= F.col("__row.source").eqNullSafe(F.col("__key.source"))
    return left.join(planned, same).drop("__row", "__key")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs``, all columns, as often as its plan says. Which of the rows that
    repeat id, text and source get one copy more follows their place in ``docs``."""
    rows = _rows_with_plan(docs, mix(docs, **options))
    return rows.filter("__plan.copies > 0").withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("__plan.copies")))
    ).drop("__copy", "__plan")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    rows = _rows_with_plan(docs, mix(docs))
    return rows.select(
        "doc_id", "__plan.size", "__plan.source_size", "__plan.target",
        (F.col("__plan.size") * F.col("__plan.copies")).alias("taken"),
    )


def _pass_sql(i: int) -> str:
    return f"""
    g{i} AS (SELECT *, CASE WHEN source_size > 0 THEN gap0 - sum(size * extra) OVER (PARTITION BY k) ELSE 0 END AS gap FROM p{i - 1}),
    f{i} AS (SELECT *, coalesce(extra = 0 AND rank IS NOT NULL AND size > 0 AND size <= gap, false) AS fits FROM g{i}),
    r{i} AS (SELECT *, sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY k ORDER BY rank, doc_id NULLS LAST, th
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM f{i}),
    p{i} AS (SELECT * EXCLUDE (extra, gap, fits, upto), CASE WHEN fits AND upto <= gap THEN 1 ELSE extra END AS extra FROM r{i})"""


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS th,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
    w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             source_size * 3.0::DOUBLE AS cap FROM r),
    l AS (SELECT *, cap / w AS level FROM w),
    c AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
             coalesce(sum(cap) OVER (ORDER BY level, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
             sum(w) OVER (ORDER BY level, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_onward FROM l),
    a AS (SELECT *, (total - cap_before) / w_onward AS water FROM c),
    b AS (SELECT *, (SELECT max(water) FROM a WHERE water <= level) AS line FROM a),
    t AS (SELECT source, k, source_size, CASE WHEN line IS NULL THEN cap ELSE least(cap, line * w) END AS target FROM b),
    e AS (SELECT d.doc_id, d.th, d.size, t.k, t.source_size, t.target,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS due,
             (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || th || ':{SEED}'), 1, 12) AS BIGINT)
               + 0.5::DOUBLE) / {float(1 << 48)!r}::DOUBLE AS u
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    o AS (SELECT *, due - floor(due) AS p, floor(due) AS certain FROM e),
    q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM o),
    p0 AS (SELECT doc_id, th, size, k, source_size, target, certain, odds / (1 + odds) AS rank, 0 AS extra,
             target - floor(target / CASE WHEN source_size > 0 THEN source_size END) * source_size AS gap0 FROM q),
    {",".join(_pass_sql(i) for i in range(1, PASSES + 1))}
SELECT doc_id, size, source_size, target, CAST(size * (certain + extra) AS BIGINT) AS taken FROM p{PASSES}
"""
