"""Connected components of a large edge table by alternating large-star and small-star
steps. No node's neighbours are gathered: every step is a minimum per node (combined
before the shuffle) and a join. Each round is written to the shared folder, so lineage
stays short and a lost executor costs one round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import written

MAX_ROUNDS = 64


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """edges (u, v) with u > v. Link neighbours to the node's smallest neighbour (or itself):
    the larger ones in the large star, the smaller ones and the node in the small star."""
    if both_ways:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = around.join(least, "u")
    if both_ways:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (u, v), any orderable type -> (node, root): every node that has an edge and is not
    the smallest of its component, with the smallest. No edges give no rows."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now, before = written(now, name), None
    for _ in range(MAX_ROUNDS):
        now = written(_star(_star(now, True), False), name)
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
