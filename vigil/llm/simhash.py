"""SimHash near-deduplication with a Gray-order hierarchical index.

Fingerprint: lower-cased (A-Z) words, 3-word shingles with repeats, XXH64 (seed 42) of each;
bit k is set if it is set in over half of the hashes. Documents link when their
fingerprints differ in at most ``distance`` bits; components of links are the groups.

Search, over distinct fingerprints only (copies meet in one row):

1. Routing. With d differing bits, one of d + 1 blocks of the 64 bits is equal, and one of
   d + 1 blocks of the remaining bits as well. A fingerprint is sent to its (d + 1)^2 keys
   of about 36 bits, so every linked pair meets under some key, and a key holds few.
2. Index. Under a key, fingerprints are sorted by Gray rank, where neighbours share long
   bit patterns. Runs of FANOUT become nodes that keep the bits all members share (mask and
   pattern); each level factors the shared bits out of the level below, which keeps the rest.
3. Search from the root: a query's differences on the bits a node adds are summed to those
   of its ancestors; a node whose sum exceeds the distance goes with everything below it.
   At a leaf the sum is the exact distance.

A query meets at most the fingerprints within the distance, and a task emits a spanning
forest of the links it found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import documents, written
from vigil.llm.graph import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
FANOUT = 8
#: Rows a task indexes at once; a key's rows stay together even beyond it.
BUFFER = 400_000
QUERIES_AT_ONCE = 50_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one whole text (null or without words: 0)."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    stops = (starts + sizes)[shingle - 1:].tolist()
    starts = starts.tolist()
    total, ones = len(stops), np.zeros(64, np.int64)
    for at in range(0, total, 65536):
        part = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at:at + 65536], stops[at:at + 65536])]
        octets = np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    values = np.array([fingerprint(t) for t in text], dtype=np.uint64)
    return pd.Series(values.view(np.int64))


def route_masks(distance: int = DISTANCE) -> list[int]:
    """Bit masks of the routing keys, as signed longs."""
    blocks = np.array_split(np.arange(64), distance + 1)
    out = []
    for i, block in enumerate(blocks):
        rest = np.concatenate([b for j, b in enumerate(blocks) if j != i]) if distance else np.arange(0)
        for part in np.array_split(rest, distance + 1):
            mask = sum(1 << int(b) for b in [*block, *part])
            out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code word in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over fingerprints sorted by (group, Gray rank); level 0 are the leaves."""

    def __init__(self, group: np.ndarray, codes: np.ndarray, fanout: int = FANOUT):
        order = np.lexsort((gray_rank(codes), group))
        self.order, self.codes, group = order, codes[order], group[order]
        ones = np.full(len(codes), ~np.uint64(0))
        self.levels = [(self.codes, ones, None)]  # pattern, mask, first child of each node
        pattern, mask = self.codes, ones
        self.last_leaf = [np.arange(len(codes))]
        while True:
            first_of_group = np.r_[True, group[1:] != group[:-1]]
            if first_of_group.all():
                break
            begin = np.flatnonzero(first_of_group)
            inside = np.arange(len(group)) - np.repeat(begin, np.diff(np.r_[begin, len(group)]))
            child = np.flatnonzero(inside % fanout == 0)
            stop = np.r_[child[1:], len(group)]
            lead = pattern[child]
            differ = np.bitwise_or.reduceat(pattern ^ np.repeat(lead, stop - child), child)
            shared = np.bitwise_and.reduceat(mask, child) & ~differ
            self.levels.append((lead & shared, shared, np.r_[child, len(group)]))
            self.last_leaf.append(self.last_leaf[-1][stop - 1])
            pattern, mask, group = lead & shared, shared, group[child]
        self.root_of = np.repeat(np.arange(len(group)), np.diff(np.r_[-1, self.last_leaf[-1]]))

    def links(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (a, b) of positions in the input with at most ``distance`` differing bits."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in range(0, len(self.codes), QUERIES_AT_ONCE):
            query = np.arange(at, min(at + QUERIES_AT_ONCE, len(self.codes)))
            node = self.root_of[query]
            pattern, known, _ = self.levels[-1]
            sums = np.bitwise_count((self.codes[query] ^ pattern[node]) & known[node]).astype(np.int64)
            for level in range(len(self.levels) - 1, 0, -1):
                near = sums <= distance
                query, node, sums = query[near], node[near], sums[near]
                upper, first = self.levels[level][1], self.levels[level][2]
                width = first[node + 1] - first[node]
                child = np.repeat(first[node], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                query, sums, parent = np.repeat(query, width), np.repeat(sums, width), np.repeat(node, width)
                behind = self.last_leaf[level - 1][child] > query  # each pair once
                child, query, sums, parent = child[behind], query[behind], sums[behind], parent[behind]
                pattern, mask, _ = self.levels[level - 1]
                added = mask[child] & ~upper[parent]
                sums = sums + np.bitwise_count((self.codes[query] ^ pattern[child]) & added)
                node = child
            near = (sums <= distance) & (node > query)
            found.append((query[near], node[near]))
        a, b = (np.concatenate(x) for x in zip(*found))
        return self.order[a], self.order[b]


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position of each position's component under links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _search(distance: int, fanout: int):
    def linked(route: np.ndarray, key: np.ndarray, codes: np.ndarray):
        same = (route[1:] == route[:-1]) & (key[1:] == key[:-1])
        pair = np.r_[False, same] | np.r_[same, False]
        group = np.cumsum(np.r_[True, ~same])[pair]
        codes = codes[pair]
        if not len(codes):
            return None
        label = spanning(len(codes), *GrayIndex(group, codes, fanout).links(distance))
        moved = np.flatnonzero(label != np.arange(len(codes)))
        return np.unique(np.stack([codes[moved], codes[label[moved]]]), axis=1) if len(moved) else None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def edges(held):
            route, key, codes = (np.concatenate(x) for x in zip(*held))
            found = linked(route, key, codes.view(np.uint64))
            if found is not None:
                u, v = (pa.array(x.view(np.int64)) for x in found)
                yield pa.RecordBatch.from_arrays([u, v], ["u", "v"])

        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(3)))
            rows += batch.num_rows
            if rows >= BUFFER:  # keep the last key: more of it may follow
                route, key, codes = (np.concatenate(x) for x in zip(*held))
                last = int(np.flatnonzero((route != route[-1]) | (key != key[-1])).max(initial=-1)) + 1
                if last:
                    yield from edges([(route[:last], key[:last], codes[:last])])
                held, rows = [(route[last:], key[last:], codes[last:])], len(route) - last
        if rows:
            yield from edges(held)

    return run


def near_links(codes: DataFrame, distance: int = DISTANCE, fanout: int = FANOUT) -> DataFrame:
    """Distinct fingerprints (fp) -> (u, v) links within ``distance`` whose components are those of
    all such links."""
    routes = F.array(*[F.struct(F.lit(i).alias("route"), F.lit(m).alias("mask")) for i, m in enumerate(route_masks(distance))])
    keyed = codes.select("fp", F.explode(routes).alias("r")).select(
        "r.route", F.col("fp").bitwiseAND(F.col("r.mask")).alias("key"), "fp"
    )
    placed = keyed.repartition("route", "key").sortWithinPartitions("route", "key")
    return placed.mapInArrow(_search(distance, fanout), "u long, v long").distinct()


def simhash_groups(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs (doc_id, text) -> one row each: doc_id, fp (long), component_id (the smallest doc_id
    of the group). Texts without words and null texts have fingerprint 0 and link like any
    other; null ids never become a group's id (a group of null ids has a null one); repeated rows
    give a row each; other columns are ignored; no rows give no rows."""
    signed = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_udf("text").alias("fp")), "simhash"
    )
    codes = signed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(codes, distance), "simhash-groups")
    rooted = codes.join(roots, codes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_code = rooted.join(groups, "root").select("fp", "component_id")
    return signed.join(by_code, "fp").select("doc_id", "fp", "component_id")


def first_of_groups(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each group kept: that of the smallest doc_id (null ids last), then
    of the smallest text hash; of equal rows one."""
    signed = docs.withColumn("__fp", fingerprint_udf("text")).withColumn("__th", F.xxhash64("text"))
    rank = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").cast("long").alias("id"), F.col("__th").alias("th"))
    rows = written(signed.select("__fp", rank.alias("rank")).distinct(), "simhash-rows")
    codes = rows.select(F.col("__fp").alias("fp")).distinct()
    roots = components(near_links(codes, distance), "simhash-groups")
    rooted = rows.join(roots, rows["__fp"] == roots["node"], "left")
    first = rooted.groupBy(F.coalesce("root", "__fp").alias("root")).agg(F.min("rank").alias("rank"))
    chosen = first.select(  # names that no column of docs has
        F.col("rank.late").alias("__late1"), F.coalesce("rank.id", F.lit(0)).alias("__id1"), F.col("rank.th").alias("__th1")
    ).distinct()
    keyed = signed.withColumn("__late", F.col("doc_id").isNull()).withColumn(
        "__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    )
    same = (F.col("__late") == F.col("__late1")) & (F.col("__id") == F.col("__id1")) & (F.col("__th") == F.col("__th1"))
    kept = keyed.join(chosen, same, "left_semi").dropDuplicates(["__late", "__id", "__th"])
    return kept.drop("__fp", "__th", "__late", "__id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    groups = simhash_groups(documents(spark, sf_dir))
    code = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return groups.select("doc_id", code.alias("fingerprint"), "component_id")
