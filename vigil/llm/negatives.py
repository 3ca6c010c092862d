"""Hard-negative mining with lists shared by clusters of anchors.

Candidates are a written table of packed blocks; so are the anchors, as chunks in order of (label,
cluster). Every chunk meets every block once (the stated query set against all rows, in
blocks). There, each cluster sorts the block's candidates by an upper bound of their score
with any of its members: the candidate's norm times the cosine of its angle to the cluster's
direction less the cluster's widest angle. All members walk that one list in strides and
leave it as soon as their tenth (fifth) best score beats the bound of what is left, which
certifies that no better candidate follows. Best scores carry over from block to block of a task;
what tasks found is merged by rank.

The first pass finds each anchor's positives, the second the negatives in the band that each
positive's score sets. Cluster centres come from a k-means of at most ``MAX_FIT`` anchors; they
only decide how early a walk ends, never what it finds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import written

SCALE = 256
ANCHOR_EVERY = 100
RELABEL_EVERY, LABELS = 7, 10
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 30, 90
#: Anchors that the k-means of the cluster centres sees, at most (those of the smallest hash).
MAX_FIT = 4096
#: Octets of a packed block or chunk, counted at eight a component.
PACK_OCTETS = 2_000_000
STRIDE = 1024
#: Octets of best scores that a task holds before it sends them on.
HELD_OCTETS = 64_000_000
NO_ID = np.iinfo(np.int64).max  # stands for a null id: after all others of the same score
LEAST = np.iinfo(np.int64).min

PACK = "pack long, width int, kind string, row binary, vec_id binary, label binary, extra binary, vectors binary"
FOUND = "anchor long, slot int, vec_id long, row long, score long"


# ---- packed vectors ------------------------------------------------------------------


@dataclass
class Pack:
    """Vectors with their row numbers, ids and labels; ``extra`` has further numbers a row (of
    a chunk: the cluster, then the scores of the positives)."""

    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    extra: np.ndarray
    vectors: np.ndarray
    norm: np.ndarray = field(init=False)

    def __post_init__(self):
        self.norm = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1))

    def __len__(self):
        return len(self.row)

    def take(self, at: np.ndarray) -> Pack:
        return Pack(self.row[at], self.vec_id[at], self.label[at], self.extra[at], self.vectors[at])

    def columns(self, number: int) -> list:
        """One PACK row, components in the narrowest integers that hold them."""
        top = int(np.abs(self.vectors).max(initial=0))
        kind = next(k for k in ("<i2", "<i4", "<i8") if top <= np.iinfo(k).max)
        octets = [a.astype("<i8").tobytes() for a in (self.row, self.vec_id, self.label, self.extra)]
        return [number, self.vectors.shape[1], kind, *octets, self.vectors.astype(kind).tobytes()]


def unpacked(row: dict) -> Pack:
    numbers = [np.frombuffer(row[c], "<i8") for c in ("row", "vec_id", "label", "extra")]
    n = len(numbers[0])
    vectors = np.frombuffer(row["vectors"], row["kind"]).astype(np.int64).reshape(n, row["width"])
    return Pack(*numbers[:3], numbers[3].reshape(n, -1) if n else np.zeros((0, 1), np.int64), vectors)


def filled(vectors: list[list], kind) -> np.ndarray:
    """Vectors as rows of a table; shorter ones are filled up with zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), kind)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def whole_numbers(vectors: list[list[float]]) -> np.ndarray:
    """floor(SCALE * x) of each component."""
    out = np.floor(SCALE * filled(vectors, np.float64))
    if np.abs(out).max(initial=0) >= 2.0**62:
        raise ValueError("a component is too large for 64-bit inner products")
    return out.astype(np.int64)


def _pack_rows(extra_width: int, by_task: bool):
    """Rows (row, vec_id, label, extra, embedding or vector) to PACK rows. ``by_task`` numbers
    the rows, by task and place."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, made, seen, held = TaskContext.get().partitionId(), 0, 0, []
        schema = pa.schema([
            ("pack", pa.int64()), ("width", pa.int32()), ("kind", pa.string()),
            *[(c, pa.binary()) for c in ("row", "vec_id", "label", "extra", "vectors")],
        ])

        def packed():
            nonlocal made
            vectors = [r["vector"] for r in held]
            pack = Pack(
                np.array([r["row"] for r in held], np.int64),
                np.array([NO_ID if r["vec_id"] is None else r["vec_id"] for r in held], np.int64),
                np.array([r["label"] for r in held], np.int64),
                np.array([r["extra"] for r in held], np.int64).reshape(len(held), extra_width),
                whole_numbers(vectors) if by_task else filled(vectors, np.int64),
            )
            made += 1
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, pack.columns((task << 32) + made)))], schema)

        octets = 0
        for batch in batches:
            for r in batch.to_pylist():
                if by_task:
                    r["row"], seen = (task << 40) + seen, seen + 1
                octets += 8 * len(r["vector"])
                held.append(r)
                if octets >= PACK_OCTETS:
                    yield packed()
                    held, octets = [], 0
        if held:
            yield packed()

    return run


# ---- bounds and walks -----------------------------------------------------------------


@dataclass
class Cluster:
    """Members of a chunk that share a list: a direction and how far the widest member is off."""

    members: np.ndarray
    label: int
    direction: np.ndarray
    angle: float

    @staticmethod
    def of(chunk: Pack, members: np.ndarray) -> Cluster:
        unit = chunk.vectors[members] / np.maximum(chunk.norm[members], 1.0)[:, None]
        mean = unit.sum(0)
        size = np.linalg.norm(mean)
        direction = mean / size if size > 1e-9 else np.eye(1, chunk.vectors.shape[1])[0]
        cosine = np.clip(unit @ direction, -1, 1)[chunk.norm[members] > 0]
        return Cluster(members, int(chunk.label[members[0]]), direction, float(np.arccos(cosine.min(initial=1.0))))

    def bounds(self, block: Pack, at: np.ndarray, products: np.ndarray) -> np.ndarray:
        """Upper bound of score / member's norm, for each candidate, from its product with the direction. The
        rounding of angles and sums is far below the allowance of 1e-7 of the candidate's norm."""
        norm = block.norm[at]
        gap = np.maximum(0.0, np.arccos(np.clip(products[at] / np.maximum(norm, 1.0), -1, 1)) - self.angle)
        return norm * (np.cos(gap) + 1e-7)


def clusters_of(chunk: Pack) -> list[Cluster]:
    order = np.lexsort((chunk.extra[:, 0], chunk.label))
    key = np.column_stack([chunk.label, chunk.extra[:, 0]])[order]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(order) else []
    return [Cluster.of(chunk, m) for m in np.split(order, new[1:])] if len(order) else []


def comparable(a: Pack, b: Pack) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of both in the narrowest numbers whose inner products are exact (by the norms, which bound
    every partial sum)."""
    width = min(a.vectors.shape[1], b.vectors.shape[1])
    limit = a.norm.max(initial=0) * b.norm.max(initial=0)
    if limit >= 2.0**62:
        raise ValueError("an inner product may not fit into 64 bits")
    kind = np.float32 if limit < 2.0**23 else np.float64 if limit < 2.0**52 else np.int64
    return a.vectors[:, :width].astype(kind), b.vectors[:, :width].astype(kind)


class Best:
    """The first ``k`` candidates of each slot: larger scores first, then ids, then rows."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.found = np.zeros((0, 4), np.int64)  # slot, score, id, row
        self.last = np.full(slots, LEAST)  # the k-th best score, LEAST while there are fewer

    def offer(self, rows: list[np.ndarray]) -> None:
        rows = np.concatenate([self.found, *rows])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        start = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
        self.found = rows[rank < self.k]
        full = rows[rank == self.k - 1]
        self.last[full[:, 0]] = full[:, 1]


def _first(hit: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Of the hits in each row of ``score``, those that are not below its k-th best."""
    if score.shape[1] <= k or np.count_nonzero(hit) <= 4 * k * len(score):
        return hit
    least = LEAST if score.dtype == np.int64 else -np.inf
    return hit & (score >= np.partition(np.where(hit, score, least), -k, axis=1)[:, -k][:, None])


def walk(best: Best, chunk: Pack, cluster: Cluster, block: Pack, at: np.ndarray, products: np.ndarray, numbers: tuple, bands: list[tuple] | None) -> None:
    """Walk a cluster's list of the candidates ``at`` of a block. Slots count the cluster's members:
    without bands slot = member; with them, band j (low, high, by anchor) of a member has slot
    ``member * len(bands) + j``."""
    bound = cluster.bounds(block, at, products)
    order = np.argsort(-bound, kind="stable")
    at, bound = at[order], bound[order]
    alive, width = np.arange(len(cluster.members)), len(bands) if bands else 1
    for begin in range(0, len(at), STRIDE):
        anchor = cluster.members[alive]
        reach = chunk.norm[anchor] * bound[begin]
        if bands is None:
            floors = [best.last[alive]]
            needed = floors[0] <= reach
        else:
            floors = [np.maximum(best.last[alive * width + j], low[anchor]) for j, (low, _) in enumerate(bands)]
            needed = np.logical_or.reduce([(f <= high[anchor]) & (f <= reach) for f, (_, high) in zip(floors, bands)])
        if not needed.any():
            return  # certified: nothing that is left can enter
        alive, anchor, floors = alive[needed], anchor[needed], [f[needed] for f in floors]
        to = at[begin:begin + STRIDE]
        score = numbers[0][anchor] @ numbers[1][to].T
        offered = []
        for j, floor in enumerate(floors):
            hit = score >= floor.astype(score.dtype)[:, None]
            if bands is None:
                hit &= block.row[to][None, :] != chunk.row[anchor][:, None]
            else:
                hit &= score <= bands[j][1][anchor].astype(score.dtype)[:, None]
            i, c = np.nonzero(_first(hit, score, best.k))
            if len(i):
                offered.append(np.column_stack([alive[i] * width + j, score[i, c].astype(np.int64), block.vec_id[to[c]], block.row[to[c]]]))
        if offered:
            best.offer(offered)


def bands_of(chunk: Pack) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each positive: the least and largest score of its negatives, by member. Places
    without a positive have an empty band."""
    out = []
    for j in range(POSITIVES):
        low, high = np.ones(len(chunk), np.int64), np.zeros(len(chunk), np.int64)
        for m in np.flatnonzero(chunk.extra[:, 1] > j).tolist():
            score = int(chunk.extra[m, 2 + j])
            low[m], high[m] = -(-LOW * score // 100), HIGH * score // 100
        out.append((low, high))
    return out


def _walks(negatives: bool):
    """Pairs of a block (columns of PACK) and a chunk (the same, with ``c_`` before) to FOUND."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([
            ("anchor", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64()),
        ])
        held: dict[int, tuple] = {}
        width, k = (POSITIVES, NEGATIVES) if negatives else (1, POSITIVES)

        def found():
            for chunk, clusters, _, bests in held.values():
                for cluster, best in zip(clusters, bests):
                    slot, score, vec_id, row = best.found.T
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(chunk.row[cluster.members[slot // width]]), pa.array((slot % width).astype(np.int32)),
                            pa.array(vec_id, pa.int64(), mask=vec_id == NO_ID), pa.array(row), pa.array(score),
                        ],
                        schema=schema,
                    )

        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                block = unpacked({c: r[c] for c in r if not c.startswith("c_")})
                if r["c_pack"] not in held:
                    chunk = unpacked({c[2:]: r[c] for c in r if c.startswith("c_")})
                    if sum(8 * c.vectors.size + 32 * len(c) * width * k for c, *_ in held.values()) > HELD_OCTETS:
                        yield from found()
                        held = {}
                    clusters = clusters_of(chunk)
                    bests = [Best(len(c.members) * width, k) for c in clusters]
                    held[r["c_pack"]] = (chunk, clusters, bands_of(chunk) if negatives else None, bests)
                chunk, clusters, bands, bests = held[r["c_pack"]]
                numbers = comparable(chunk, block)
                narrow = numbers[1].shape[1]
                products = np.array([c.direction[:narrow] for c in clusters]).reshape(len(clusters), narrow) @ block.vectors[:, :narrow].astype(np.float64).T
                lists: dict[int, np.ndarray] = {}
                for cluster, best, product in zip(clusters, bests, products):
                    if cluster.label not in lists:
                        same = block.label == cluster.label
                        lists[cluster.label] = np.flatnonzero(~same if negatives else same)
                    walk(best, chunk, cluster, block, lists[cluster.label], product, numbers, bands)
        yield from found()

    return run


# ---- clusters of anchors -----------------------------------------------------------------


def centres(vectors: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Directions of a spherical k-means over the fitting sample."""
    norm = np.linalg.norm(vectors, axis=1)
    unit = vectors[norm > 0] / norm[norm > 0][:, None]
    k = max(1, round(np.sqrt(len(unit)) / 2))
    if not len(unit):
        return np.zeros((1, vectors.shape[1]))
    chosen = unit[np.linspace(0, len(unit) - 1, k).astype(int)]
    for _ in range(rounds):
        nearest = (unit @ chosen.T).argmax(1)
        total = np.zeros_like(chosen)
        np.add.at(total, nearest, unit)
        size = np.linalg.norm(total, axis=1)
        chosen = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], chosen)
    return chosen


def _anchors_of(every: int):
    """Blocks to the anchors in them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                block = unpacked(r)
                at = np.flatnonzero((block.vec_id % every == 0) & (block.vec_id != NO_ID))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block.row[at]), pa.array(block.vec_id[at]), pa.array(block.label[at]),
                        pa.array(block.vectors[at].tolist(), pa.list_(pa.int64())),
                    ],
                    ["row", "vec_id", "label", "vector"],
                )

    return run


def _nearest(chosen: np.ndarray):
    """Anchors with the number of their cluster."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector")).to_pylist()
            cluster = np.zeros(len(vectors), np.int64)
            for i, v in enumerate(vectors):
                width = min(len(v), chosen.shape[1])
                cluster[i] = int((chosen[:, :width] @ np.array(v[:width], np.float64)).argmax()) if width else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster)], [*batch.schema.names, "cluster"])

    return run


def _chunks(anchors: DataFrame, octets: int, extra_width: int, name: str) -> DataFrame:
    """Anchors (row, vec_id, label, cluster, vector, extra) as chunks, neighbours together."""
    rows = anchors.select("row", "vec_id", "label", "cluster", "extra", "vector")
    rows = rows.repartitionByRange(max(1, -(-octets // PACK_OCTETS)), "label", "cluster", "row")
    rows = rows.sortWithinPartitions("label", "cluster", "row").drop("cluster")
    return written(rows.mapInArrow(_pack_rows(extra_width, False), PACK), name)


def _met(blocks: DataFrame, chunks: DataFrame, negatives: bool) -> DataFrame:
    """What the walks of every chunk over every block found, and the best of it."""
    pairs = blocks.crossJoin(chunks.select(*[F.col(c).alias(f"c_{c}") for c in chunks.columns]))
    found = pairs.mapInArrow(_walks(negatives), FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= (NEGATIVES if negatives else POSITIVES))


def _finite(vector):
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def hard_negatives(vectors: DataFrame, anchor_every: int = ANCHOR_EVERY) -> DataFrame:
    """vectors (vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score: for each anchor (id divisible by ``anchor_every``) and each of its POSITIVES best rows of the
    same label, the NEGATIVES best rows of other labels whose score lies in the positive's band.

    Rows with a null label, a null vector or a component that is null or not finite take no
    part. A null id is no anchor, and comes after all ids of its score. Repeated rows are rows
    of their own: each is an anchor, a positive or a negative (ties of score and id by place).
    A shorter vector counts as filled up with zeros; an empty one scores zero. Scores that do not fit into 64 bits
    are an error. Other columns are ignored; no rows give no rows."""
    used = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    used = used.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & _finite(F.col("vector")))
    used = used.select(F.lit(0).cast("long").alias("row"), "vec_id", "label", F.array(F.lit(0).cast("long")).alias("extra"), "vector")
    blocks = written(used.mapInArrow(_pack_rows(1, True), PACK), "vector-blocks")

    anchors = blocks.mapInArrow(_anchors_of(anchor_every), "row long, vec_id long, label long, vector array<long>")
    sample = anchors.orderBy(F.xxhash64("row"), "row").limit(MAX_FIT).select("vector").toPandas()["vector"]
    wide = max(map(len, sample), default=0)
    chosen = centres(np.array([np.pad(np.asarray(v, np.float64), (0, wide - len(v))) for v in sample]).reshape(len(sample), wide))
    anchors = written(
        anchors.mapInArrow(_nearest(chosen), "row long, vec_id long, label long, vector array<long>, cluster long"), "anchors"
    )
    size = anchors.agg(F.sum(F.size("vector") * 8)).first()[0] or 0  # one row
    chunks = _chunks(anchors.withColumn("extra", F.array("cluster")), size, 1, "anchor-chunks")

    positives = written(_met(blocks, chunks, negatives=False), "positives")
    listed = positives.groupBy("anchor").agg(  # at most POSITIVES a group
        F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("best")
    )
    seen = anchors.join(listed, F.col("row") == F.col("anchor")).withColumn(
        "extra",
        F.concat(
            F.array("cluster", F.size("best").cast("long")),
            F.transform(F.sequence(F.lit(0), F.lit(POSITIVES - 1)), lambda i: F.coalesce(F.get("best.score", i), F.lit(0).cast("long"))),
        ),
    )
    chunks = _chunks(seen, size, 2 + POSITIVES, "positive-chunks")
    negatives = _met(blocks, chunks, negatives=True)
    return (
        positives.select(
            "anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        )
        .join(negatives.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "slot"])
        .join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved))


#: The same rows by full comparison.
ORACLE_SQL = """
WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM used a JOIN used b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) <= 10
"""
