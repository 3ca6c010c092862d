"""Chunks of whole documents, and exchanges of hashed keys between them.

Deduplication looks for keys (windows of words, minimisers of octets) that chunks share. Keys
outnumber documents by far, so a chunk does not send a row per key: it sorts its keys and
sends one packed blob per bucket (a range of the hash). The task of a bucket sees all
chunks' blobs and answers with one bit per key, in the order it came, so an answer needs
no key. A chunk recomputes its keys to read the answers.

Chunks are a table in the shared folder, bucketed by ``slot``; answers, gathered by slot, join it
without moving the texts again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_OCTETS = 2_500_000
#: Slots a writing task deals its chunks to: its files, and what one answer row may gather.
SLOTS = 8
LAST = np.iinfo(np.int64).max  # stands for a null id: after all others

CHUNK = "slot int, chunk long, ids array<long>, data binary, ends array<long>"
BLOB = "bucket int, kind int, slot int, chunk long, keys binary, extra binary"
ANSWER = "slot int, chunk long, bucket int, kind int, bits binary"


def _to_chunks(octets: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0

        def chunk(ids, texts, rest, kind):
            nonlocal made
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            row = [
                pa.array([task * SLOTS + made % SLOTS], pa.int32()), pa.array([(task << 32) + made], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())), pa.array([b"\n".join([*texts, b""])], pa.binary()),
                pa.array([(np.cumsum(sizes + 1) - 1).tolist()], pa.list_(pa.int64())), pa.array([rest], pa.list_(kind)),
            ]
            made += 1
            return pa.RecordBatch.from_arrays(row, ["slot", "chunk", "ids", "data", "ends", "rest"])

        ids, texts, rest, held, kind = [], [], [], 0, None
        for batch in batches:
            kind = batch.schema.field(2).type
            for doc_id, text, other in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = text.as_py() or b""
                if texts and held + len(text) > octets:
                    yield chunk(ids, texts, rest, kind)
                    ids, texts, rest, held = [], [], [], 0
                ids.append(doc_id)
                texts.append(text)
                rest.append(other.as_py())
                held += len(text)
        if texts:
            yield chunk(ids, texts, rest, kind)

    return run


def carried(docs: DataFrame, carry: list[str]) -> T.StructType:
    """The type of what a document carries along, beside id and text."""
    return T.StructType([docs.schema[c] for c in carry] or [T.StructField("none", T.BooleanType())])


def chunk_table(docs: DataFrame, carry: list[str] | None = None, octets: int = CHUNK_OCTETS) -> DataFrame:
    """docs (doc_id, text) as a bucketed table of chunks of about ``octets`` (a longer text is a
    chunk of its own): whole UTF-8 texts, each followed by a newline, and where they end.
    Columns named in ``carry`` go along as the struct ``rest``."""
    from vigil.session import scratch_path  # not a name of the module, which travels to workers by value

    spark = docs.sparkSession
    rest = F.struct(*[docs[c] for c in carry]) if carry else F.struct(F.lit(None).cast("boolean").alias("none"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"),
        rest.alias("rest"),
    )
    schema = T.StructType(T.StructType.fromDDL(CHUNK).fields + [T.StructField("rest", T.ArrayType(carried(docs, carry or [])))])
    chunks = rows.mapInArrow(_to_chunks(octets), schema)
    name = f"llm_chunks_{uuid.uuid4().hex[:12]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks.write.bucketBy(buckets, "slot").option("path", scratch_path(spark, "chunks")).saveAsTable(name)
    return spark.table(name)


def with_rest(rows: str, docs: DataFrame, carry: list[str] | None) -> T.StructType:
    """A result schema with the struct ``rest`` behind it."""
    return T.StructType(T.StructType.fromDDL(rows).fields + [T.StructField("rest", carried(docs, carry or []))])


def bucket_bits(spark) -> int:
    """Four buckets per shuffle partition: what a bucket's task holds stays the same as both grow."""
    return max(2, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


class Chunk:
    """One chunk row in a worker: octets, document borders, ids with nulls last. What other columns hold,
    answers and what documents carry along, stays in Arrow."""

    def __init__(self, row: dict, joined: dict):
        self.row, self.joined = row, joined
        self.slot, self.chunk, self.data = row["slot"], row["chunk"], row["data"]
        self.octets = np.frombuffer(row["data"], np.uint8)
        self.ends = np.array(row["ends"], np.int64)
        self.starts = np.r_[0, self.ends[:-1] + 1] if len(self.ends) else self.ends
        self.ids = np.array([LAST if i is None else i for i in row["ids"]], np.int64)

    def rest(self):
        """What the documents carry along, as an Arrow array."""
        return self.joined["rest"]

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """(first halves, order): 128-bit digests of the texts and their order by it."""
        from hashlib import blake2b

        raw = b"".join(blake2b(self.text(i), digest_size=16).digest() for i in range(len(self.ends)))
        digest = np.frombuffer(raw, dtype="<u8").reshape(-1, 2)
        return digest, np.lexsort((digest[:, 1], digest[:, 0]))

    def given(self, column: str, kind: int | None = None):
        """This chunk's structs in a joined column, which holds those of its whole slot (of one kind); None if there are none."""
        import pyarrow as pa

        found = self.joined[column]
        if found is None or not len(found):
            return None
        mine = found.field("chunk").to_numpy() == self.chunk
        if kind is not None:
            mine &= found.field("kind").to_numpy() == kind
        return found.take(pa.array(np.flatnonzero(mine))) if mine.any() else None

    def answers(self, column: str, kind: int) -> Answers | None:
        """Of this chunk's answers in a joined column: buckets, their bits, where each one's begin and the last one's end."""
        found = self.given(column, kind)
        return found and (found.field("bucket").to_numpy().astype(np.int64), *octets_of(found.field("bits")))


def slices(sorted_hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of ascending 64-bit hashes, by their top bits."""
    bucket = (sorted_hashes >> np.uint64(64 - bits)).astype(np.int64)
    begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(begin, np.r_[begin[1:], len(bucket)] if len(begin) else []):
        yield int(bucket[a]), slice(int(a), int(b))


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] numbers), begin[1], ..."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def octets_of(values) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow array of binaries as one array of octets, and where each one begins (and the last one ends)."""
    import pyarrow as pa

    values = values.cast(pa.large_binary())
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, borders, octets = values.buffers()
    borders = np.frombuffer(borders, np.int64)[values.offset:values.offset + len(values) + 1]
    return np.frombuffer(octets or b"", np.uint8)[borders[0]:borders[-1]], borders - borders[0]


def packed(flags: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The flags of one after another, ``sizes`` each, as bits that begin with an octet of their own: octets, and
    where each one's begin (and the last one's end)."""
    borders = np.r_[0, np.cumsum(-(-sizes // 8))]
    wide = np.zeros(8 * borders[-1], bool)
    wide[ranges(8 * borders[:-1], sizes)] = flags
    return np.packbits(wide), borders


def bit_at(octets: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (octets[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


#: buckets, the octets of their bits, where each one's begin and the last one's end
Answers = tuple[np.ndarray, np.ndarray, np.ndarray]


def read_bits(sorted_hashes: np.ndarray, answers: Answers | None, bits: int, nth: int = 0) -> np.ndarray:
    """The answers to ascending keys, as booleans; a bucket that did not answer said no. Answers may
    have a further bit for each key, behind the first ones of all: the ``nth`` is read."""
    out = np.zeros(len(sorted_hashes), bool)
    if answers is None:
        return out
    asked, octets, borders = answers
    bucket = (sorted_hashes >> np.uint64(64 - bits)).astype(np.int64)
    first = np.searchsorted(bucket, asked)
    size = np.searchsorted(bucket, asked, side="right") - first
    bit = ranges(nth * size, size)
    said = bit < np.repeat(8 * np.diff(borders), size)  # beyond, no
    out[ranges(first, size)[said]] = bit_at(octets, (np.repeat(8 * borders[:-1], size) + bit)[said])
    return out


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): the order that sorts by the keys, and where each distinct one starts."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        ranked = key[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    return order, np.flatnonzero(new)


def blob_batch(blobs: list[tuple], slot: int, chunk: int):
    """(bucket, kind, keys, extra) tuples of a chunk as an Arrow batch of BLOB rows."""
    import pyarrow as pa

    bucket, kind, keys, extra = zip(*blobs) if blobs else ((), (), (), ())
    n = len(bucket)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array([slot] * n, pa.int32()),
            pa.array([chunk] * n, pa.int64()), pa.array(keys, pa.binary()), pa.array(extra, pa.binary()),
        ],
        ["bucket", "kind", "slot", "chunk", "keys", "extra"],
    )


#: (keys, extra) of each blob -> what it is answered: a flag for each key, or octets
Judge = Callable[[list[bytes], list[bytes]], list[np.ndarray] | list[bytes]]


def digest_blobs(chunk: Chunk, kind: int, bits: int) -> list[tuple]:
    """Blobs of whole texts: digests and ids."""
    digest, order = chunk.digests()
    first = digest[order, 0]
    return [
        (bucket, kind, digest[order[part]].tobytes(), chunk.ids[order[part]].tobytes())
        for bucket, part in slices(first, bits)
    ]


def judge_digests(keys: list[bytes], extra: list[bytes]) -> list[np.ndarray]:
    """For each text: has an equal text a smaller id?"""
    digest = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)
    ids = np.frombuffer(b"".join(extra), dtype="<i8")
    order, starts = groups(digest[:, 0], digest[:, 1])
    least = np.minimum.reduceat(ids[order], starts)
    owner = np.empty(len(ids), np.int64)
    owner[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(ids)]))
    return split(least[owner] < ids, [len(e) // 8 for e in extra])


def repeated_texts(chunk: Chunk, column: str, kind: int, bits: int) -> np.ndarray:
    """For each document of a chunk: did :func:`judge_digests` find an equal text before it?"""
    digest, order = chunk.digests()
    out = np.zeros(len(chunk.ids), bool)
    out[order] = read_bits(digest[order, 0], chunk.answers(column, kind), bits)
    return out


def split(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def _bucket_tasks(judges: dict[int, Judge]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def answered(rows: list[tuple]):
            out = []
            for kind, judge in judges.items():
                mine = [r for r in rows if r[1] == kind]
                if mine:
                    bits = judge([r[4] for r in mine], [r[5] for r in mine])
                    said = [b if isinstance(b, bytes) else np.packbits(b).tobytes() if b.any() else b"" for b in bits]
                    out += [(r[2], r[3], r[0], kind, b) for r, b in zip(mine, said) if b]
            columns = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["slot", "chunk", "bucket", "kind", "bits"]
            )

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if held and held[-1][0] != row[0]:
                    yield answered(held)
                    held = []
                held.append(row)
        if held:
            yield answered(held)

    return run


def exchange(blobs: DataFrame, judges: dict[int, Judge]) -> DataFrame:
    """Blob rows to answer rows, gathered by slot: (slot, answers)."""
    answers = (
        blobs.repartition("bucket").sortWithinPartitions("bucket", "chunk")
        .mapInArrow(_bucket_tasks(judges), ANSWER)
    )
    return answers.groupBy("slot").agg(F.collect_list(F.struct("chunk", "bucket", "kind", "bits")).alias("answers"))


def rows_of(batches: Iterator) -> Iterator[Chunk]:
    for batch in batches:
        own = batch.select(["slot", "chunk", "ids", "data", "ends"])
        joined = {name: batch.column(name) for name in batch.schema.names if name not in own.schema.names}
        for i in range(batch.num_rows):
            yield Chunk(own.slice(i, 1).to_pylist()[0], {name: column[i].values for name, column in joined.items()})


# ---- hashes of octets ------------------------------------------------------------------


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h
