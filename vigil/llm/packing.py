"""Packing: documents into token sequences of a fixed length, first-fit decreasing.

Documents are dealt at random (a hash of id and text) into groups of about
``group_tokens`` tokens; every group is packed on its own, in one Python worker, so memory
is bounded by the group and by the longest document. Within a group

1. a document of ``length`` tokens or more gives up its full sequences at once;
2. the rests are placed in decreasing size into the first sequence with room, found by a
   tournament tree over the sequences' free capacities (O(log n) each);
3. where the rests would fit into fewer sequences, the emptiest are dissolved: their
   pieces are cut to fill the largest gaps;
4. the one emptiest sequence left is cut at powers of two, which need no padding.

Padding per group is therefore below one sequence, whatever the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import documents
from vigil.llm.tokens import encoder

LENGTH = 4096
GROUP_TOKENS = 2_000_000
END_ID = 2

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)


class Tournament:
    """Free capacities of ``n`` bins in a complete binary tree of maxima."""

    def __init__(self, n: int, capacity: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.best = [capacity] * (2 * self.size)

    def place(self, need: int) -> int:
        """Take ``need`` from the first bin that has it; its index. One bin per item must exist."""
        best, at = self.best, 1
        while at < self.size:
            at *= 2
            if best[at] < need:
                at += 1
        found = at - self.size
        best[at] -= need
        while at > 1:
            at //= 2
            best[at] = max(best[2 * at], best[2 * at + 1])
        return found


def pack_group(lengths: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, size) that hold every token of every item once."""
    full, rests = [], []
    for item, n in enumerate(lengths):
        whole = n - n % length
        full += [[(item, start, length)] for start in range(0, whole, length)]
        if n > whole:
            rests.append((n - whole, item, whole))
    rests.sort(key=lambda r: (-r[0], r[1]))
    bins: list[list[tuple[int, int, int]]] = []
    used: list[int] = []
    tree = Tournament(len(rests), length)
    for size, item, start in rests:
        at = tree.place(size)
        if at == len(bins):
            bins.append([])
            used.append(0)
        bins[at].append((item, start, size))
        used[at] += size
    order = sorted(range(len(bins)), key=lambda b: used[b])
    fewest = -(-sum(used) // length)
    donors, order = order[: len(bins) - fewest], order[len(bins) - fewest:]  # order: largest gap first
    gaps = iter(order)
    into = next(gaps, None)
    for donor in donors:
        for item, start, size in bins[donor]:
            while size:
                while used[into] == length:
                    into = next(gaps)
                part = min(size, length - used[into])
                bins[into].append((item, start, part))
                used[into] += part
                start, size = start + part, size - part
    kept = [bins[b] for b in order]
    if order:
        at = min(range(len(order)), key=lambda k: used[order[k]])
        if used[order[at]] < length:
            kept[at:at + 1] = _powers_of_two(kept[at], used[order[at]])
    return full + kept


def _powers_of_two(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """Cut one short sequence into sequences whose sizes are the powers of two of its size."""
    out, todo = [], list(reversed(pieces))
    for bit in range(total.bit_length() - 1, -1, -1):
        room = total & (1 << bit)
        if not room:
            continue
        one: list[tuple[int, int, int]] = []
        while room:
            item, start, size = todo.pop()
            part = min(size, room)
            one.append((item, start, part))
            room -= part
            if part < size:
                todo.append((item, start + part, size - part))
        out.append(one)
    return out


def _pack_partition(path: str, style: str, length: int, group_tokens: int, end_id: int, special_tokens: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(path, style, special_tokens).many
        end = np.array([end_id], dtype="<u4").tobytes()
        base, made = TaskContext.get().partitionId() << 40, 0

        def packed(group: list[tuple[int | None, bytes]]):
            nonlocal made
            rows: list[list] = [[] for _ in range(7)]
            for seq in pack_group([len(ids) // 4 for _, ids in group], length):
                offset = 0
                for item, start, size in seq:
                    doc_id, ids = group[item]
                    row = (doc_id, start, size, ids[4 * start:4 * (start + size)], len(ids) // 4, base + made, offset)
                    for column, value in zip(rows, row):
                        column.append(value)
                    offset += size
                made += 1
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds)], names)

        group, tokens = [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids += end
                group.append((doc_id, ids))
                tokens += len(ids) // 4
                if tokens >= group_tokens:
                    yield packed(group)
                    group, tokens = [], 0
        if group:
            yield packed(group)

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    style: str = "plain",
    length: int = LENGTH,
    group_tokens: int = GROUP_TOKENS,
    end_id: int = END_ID,
    special_tokens: bool = False,
) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``length`` tokens.

    Returns one row per piece: doc_id, start (ids of its document before it), length, ids
    (little-endian uint32), doc_tokens, sequence_id, offset in the sequence. A null text is
    empty (one piece: the end id); rows that repeat an id, or are equal, are packed each on
    their own; a null id stays null; other columns are ignored; no rows give no rows.
    With ``special_tokens``, the string of a special token in a text is that token, as in the
    tokenizers library by default; otherwise it is ordinary text.
    ``length`` must be a power of two for step 4 of the module text to save padding.
    """
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spread = F.xxhash64("doc_id", F.xxhash64("text"))
    ordered = dealt.repartition(spread).sortWithinPartitions(spread, "doc_id")
    return ordered.mapInArrow(_pack_partition(tokenizer, style, length, group_tokens, end_id, special_tokens), PIECES)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), "word", special_tokens=True)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
