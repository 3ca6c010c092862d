"""Token files: ids in Simple-8b words, with per-block offsets, written and read by Spark.

File format (one Parquet row per page; ``shard`` ascends with doc_id, ``page`` within it):

    doc_ids, doc_tokens   the page's documents and how many ids each has
    words                 little-endian uint64; the top 4 bits select how many values of
                          which width fill the low 60 bits, lowest bits first
    offsets               little-endian uint32: the first word of each block of BLOCK ids,
                          so any block decodes alone; every block starts a new word
    escapes               little-endian uint64 values of 2^60 or more; selector 15 holds
                          an index into them

Documents never span pages, so a page is read back without its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import by_id, documents
from vigil.llm.tokens import encoder
from vigil.session import scratch_path

BLOCK = 1024
PAGE_IDS = 400_000
END_ID = 2
ESCAPE = 15
# ---- Fixed values: values per word and bits per value of selectors 0 to 13 --------------
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
# -----------------------------------------------------------------------------------------

PAGES = (
    "shard int, page int, n_ids long, doc_ids array<long>, doc_tokens array<long>, "
    "words binary, offsets binary, escapes binary"
)


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    high = (ids >> np.uint64(32)).astype(np.float64)  # halves are exact as doubles
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, np.frexp(high)[1] + 32, low).astype(np.uint8)


def encode_ids(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, block offsets, escapes) of unsigned ids."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    # greedy choice at every position: the selector with most values whose values all fit. Blocks are
    # rows, with zeros behind their ends, which fit everywhere.
    n_blocks = -(-n // block)
    bits = np.zeros((n_blocks, block + max(COUNTS)), np.uint8)
    padded = np.zeros(n_blocks * block, np.uint8)
    padded[:n] = _bit_lengths(ids)
    bits[:, :block] = padded.reshape(n_blocks, block)
    chosen = np.full((n_blocks, block), ESCAPE, np.uint8)
    widest, reach = bits, 1  # the bits that the next ``reach`` values need
    for selector in range(len(COUNTS) - 1, -1, -1):  # counts ascend, so that the last that fits stays
        count = COUNTS[selector]
        while reach < count:
            more = min(reach, count - reach)
            widest = np.maximum(widest[:, :-more], widest[:, more:])
            reach += more
        chosen[widest[:, :block] <= WIDTHS[selector]] = selector
    chosen = chosen.reshape(-1)[:n]
    at = np.arange(n, dtype=np.int64)
    left = np.minimum((at // block + 1) * block, n) - at
    step = np.minimum(np.array([*COUNTS, 0, 1], np.int64)[chosen], left)
    # follow the choices, all blocks in step
    cur = np.arange(0, n, block, dtype=np.int64)
    stop = np.minimum(cur + block, n)
    owner = np.arange(len(cur))
    seen_at, seen_block = [], []
    while len(cur):
        seen_at.append(cur)
        seen_block.append(owner)
        cur = cur + step[cur]
        more = cur < stop
        cur, stop, owner = cur[more], stop[more], owner[more]
    starts, owners = np.concatenate(seen_at), np.concatenate(seen_block)
    order = np.argsort(starts, kind="stable")
    starts, owners = starts[order], owners[order]
    words = np.zeros(len(starts), np.uint64)
    kinds = chosen[starts]
    padded = np.concatenate([ids, np.zeros(max(COUNTS), np.uint64)])
    for selector, (count, width) in enumerate(zip(COUNTS, WIDTHS)):
        pick = np.flatnonzero(kinds == selector)
        if not len(pick):
            continue
        lanes = np.arange(count)
        values = padded[starts[pick][:, None] + lanes]
        values[lanes >= step[starts[pick]][:, None]] = 0
        values <<= (lanes * width).astype(np.uint64)
        words[pick] = np.bitwise_or.reduce(values, axis=1) | np.uint64(selector << 60)
    pick = np.flatnonzero(kinds == ESCAPE)
    escapes = ids[starts[pick]]
    words[pick] = np.arange(len(pick), dtype=np.uint64) | np.uint64(ESCAPE << 60)
    offsets = np.searchsorted(owners, np.arange(owners[-1] + 1)).astype(np.uint32)
    return words, offsets, escapes


def decode_ids(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of :func:`encode_ids`, decoded selector by selector over all words."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    kinds = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([*COUNTS, 0, 1], np.int64)[kinds]
    before = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets.astype(np.int64), len(words))))
    starts = before - before[offsets.astype(np.int64)][owner] + owner * block
    ends = np.minimum((owner + 1) * block, n)
    for selector, (count, width) in enumerate(zip(COUNTS, WIDTHS)):
        pick = np.flatnonzero(kinds == selector)
        if not len(pick):
            continue
        lanes = np.arange(count)
        values = (words[pick][:, None] >> (lanes * width).astype(np.uint64)) & np.uint64((1 << width) - 1)
        to = starts[pick][:, None] + lanes
        inside = to < ends[pick][:, None]
        out[to[inside]] = values[inside]
    pick = np.flatnonzero(kinds == ESCAPE)
    out[starts[pick]] = escapes[(words[pick] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def _encode_partition(path: str, style: str, end_id: int, page_ids: int, special_tokens: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(path, style, special_tokens).many
        end = np.array([end_id], dtype="<u4").tobytes()
        shard, page = TaskContext.get().partitionId(), 0

        def one_page(doc_ids, parts):
            nonlocal page
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            words, offsets, escapes = encode_ids(ids)
            row = [
                pa.array([shard], pa.int32()), pa.array([page], pa.int32()), pa.array([len(ids)], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([[len(p) // 4 for p in parts]], pa.list_(pa.int64())),
                *(pa.array([x.tobytes()], pa.binary()) for x in (words.astype("<u8"), offsets.astype("<u4"), escapes.astype("<u8"))),
            ]
            page += 1
            return pa.RecordBatch.from_arrays(
                row, ["shard", "page", "n_ids", "doc_ids", "doc_tokens", "words", "offsets", "escapes"]
            )

        doc_ids, parts, held = [], [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids += end
                doc_ids.append(doc_id)
                parts.append(ids)
                held += len(ids) // 4
                if held >= page_ids:
                    yield one_page(doc_ids, parts)
                    doc_ids, parts, held = [], [], 0
        if parts:
            yield one_page(doc_ids, parts)

    return run


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, style: str = "plain", end_id: int = END_ID, page_ids: int = PAGE_IDS,
    special_tokens: bool = False,
) -> None:
    """Encode ``docs`` (doc_id, text) and write token files to ``folder`` in ascending doc_id.

    A null text is empty (the end id alone); null ids come last; rows of one id are ordered by
    text; other columns are ignored; no documents give files without pages. With
    ``special_tokens``, the string of a special token in a text is that token, as in the tokenizers
    library by default; otherwise it is ordinary text."""
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(by_id())
        .sortWithinPartitions(by_id(), "text")
    )
    pages = ordered.mapInArrow(_encode_partition(tokenizer, style, end_id, page_ids, special_tokens), PAGES)
    pages.write.option("compression", "none").parquet(folder)


def _decode_partition(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            words, offsets, escapes = (
                np.frombuffer(row[k], dtype=t) for k, t in (("words", "<u8"), ("offsets", "<u4"), ("escapes", "<u8"))
            )
            ids = decode_ids(words, offsets, escapes, row["n_ids"])
            data = (ids.astype("<u4") if not len(escapes) else ids).tobytes()
            size = 4 if not len(escapes) else 8
            counts = np.array(row["doc_tokens"], np.int64)
            stops = np.cumsum(counts)
            k = len(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"]] * k, pa.int32()), pa.array([row["page"]] * k, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(stops - counts), pa.array(counts),
                    pa.array([data[size * (b - c):size * b] for b, c in zip(stops.tolist(), counts.tolist())], pa.binary()),
                ],
                ["shard", "page", "doc_id", "start", "n_tokens", "ids"],
            )


def read_tokens(spark: SparkSession, folder: str, *values: Column | str) -> DataFrame:
    """Documents of token files: doc_id, start (ids of all documents before), n_tokens and
    ``values``: columns made of ids (little-endian uint32; 64-bit if a page has escapes), by
    default ids themselves. They are computed where the page is decoded, so that only they
    move when the offset is joined. Offsets come from the page sizes alone: running sums
    within a shard, then over the shards (one row each)."""
    pages = spark.read.schema(PAGES).parquet(folder)
    sizes = pages.select("shard", "page", "n_ids")
    in_shard = Window.partitionBy("shard").orderBy("page")
    before = F.sum("n_ids").over(in_shard) - F.col("n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    shard_before = F.sum("total").over(Window.orderBy("shard")) - F.col("total")
    offsets = (
        sizes.withColumn("before", before)
        .join(shards.select("shard", shard_before.alias("shard_before")), "shard")
        .select("shard", "page", (F.col("before") + F.col("shard_before")).alias("before"))
    )
    docs = pages.mapInArrow(
        _decode_partition, "shard int, page int, doc_id long, start long, n_tokens long, ids binary"
    ).select("shard", "page", "doc_id", "start", "n_tokens", F.struct(*(values or ["ids"])).alias("values"))
    return docs.join(offsets, ["shard", "page"]).select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "values.*"
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "token-files")
    write_tokens(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), "byte", special_tokens=True)
    return read_tokens(spark, folder, F.crc32("ids").alias("ids_crc32"))
