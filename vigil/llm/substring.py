"""Substring deduplication on words by fixed-block anchors.

A window is WINDOW consecutive words. Every document's non-overlapping blocks of
BLOCK = (WINDOW + 1) // 2 words are indexed; every rolling window of BLOCK words probes the
index. Any WINDOW words contain a whole indexed block wherever the blocks fall, so two
documents that share a window meet at a block, and both learn it (round 1).

Hits are extended (round 2): the windows of WINDOW words around a hit are compared, and a
window whose words also start in a document with a smaller id is removed; consecutive
ones make up the maximal exact repeats. Texts that equal an earlier one take no part in
round 2: they repeat whole.

Keys travel as packed blobs (see ``blocks``). Round 1 only proposes, by a fast hash that equal words share;
round 2 compares 128-bit BLAKE2 digests of a window's own octets (words joined by one space).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import blocks
from vigil.llm.blocks import Chunk
from vigil.llm.common import documents, written

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
ANCHORS, TEXTS, REPEATS = 0, 1, 2

ROWS = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start: long, stop: long>>"


class Words:
    """The words of a chunk: borders, document and hash of each."""

    def __init__(self, chunk: Chunk):
        blank = np.zeros(256, bool)
        blank[[9, 10, 11, 12, 13, 32]] = True
        inside = ~blank[chunk.octets]
        edge = np.diff(np.r_[False, inside, False].astype(np.int8))
        self.start, self.stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(chunk.ends, self.start, side="right")
        self.count = np.bincount(self.doc, minlength=len(chunk.ends))
        self.first = np.cumsum(self.count) - self.count
        size = self.stop - self.start
        if not len(size):
            self.hash = np.zeros(0, np.uint64)
            return
        begin = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(begin, size)
        power = np.cumprod(np.full(size.max(), 0x9E3779B97F4A7C15, np.uint64))
        values = blocks.random_words(256, 1)[chunk.octets[inside]] * power[place]
        self.hash = blocks.mixed(np.add.reduceat(values, begin) + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def windows(self, k: int, seed: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of the ``k`` words from each position (or from positions ``at``)."""
        factors = blocks.random_words(k, seed)
        n = max(0, len(self.hash) - k + 1)
        out = np.zeros(n if at is None else len(at), np.uint64)
        for j, f in enumerate(factors):
            out += (self.hash[j:j + n] if at is None else self.hash[at + j]) * f
        return blocks.mixed(out)

    def whole(self, k: int) -> np.ndarray:
        """Positions from which ``k`` words lie in one document."""
        n = max(0, len(self.hash) - k + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1:k - 1 + n])


class Anchors:
    """Round 1 of a chunk: its distinct rolling block hashes, ascending."""

    def __init__(self, words: Words):
        self.at = words.whole(BLOCK)
        h = words.windows(BLOCK, 7)[self.at]
        order, starts = blocks.groups(h)
        self.keys = h[order[starts]] if len(h) else h
        self.key_of = np.empty(len(h), np.int64)
        self.key_of[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(h)]))
        self.order, self.begin = order, starts

    def flags(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Of each key: is it an indexed block here; do several documents here have it?"""
        if not len(self.keys):
            return np.zeros(0, bool), np.zeros(0, bool)
        at = self.at[self.order]
        doc = words.doc[at]
        indexed = (at - words.first[doc]) % BLOCK == 0
        several = np.minimum.reduceat(doc, self.begin) != np.maximum.reduceat(doc, self.begin)
        return np.logical_or.reduceat(indexed, self.begin), several


def _short(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits below the bucket's."""
    return ((hashes >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def _emit_anchors(bits: int):
    def run(batches: Iterator) -> Iterator:
        for chunk in blocks.rows_of(batches):
            words = Words(chunk)
            anchors = Anchors(words)
            indexed, several = anchors.flags(words)
            short = _short(anchors.keys, bits)
            out = [
                (b, ANCHORS, short[p].tobytes(), np.packbits(np.concatenate([indexed[p], several[p]])).tobytes())
                for b, p in blocks.slices(anchors.keys, bits)
            ]
            yield blocks.blob_batch(out + blocks.digest_blobs(chunk, TEXTS, bits), chunk.slot, chunk.chunk)

    return run


def _judge_anchors(keys: list[bytes], extra: list[bytes]) -> list[np.ndarray]:
    """A key is a hit if it is an indexed block somewhere and several documents have it."""
    sizes = [len(k) // 4 for k in keys]
    short = np.frombuffer(b"".join(keys), dtype="<u4")
    flags = [np.unpackbits(np.frombuffer(e, np.uint8), count=2 * n).astype(bool) for e, n in zip(extra, sizes)]
    indexed = np.concatenate([f[:n] for f, n in zip(flags, sizes)])
    several = np.concatenate([f[n:] for f, n in zip(flags, sizes)])
    order, starts = blocks.groups(short)
    count = np.diff(np.r_[starts, len(short)])
    hit = np.logical_or.reduceat(indexed[order], starts) & ((count > 1) | np.logical_or.reduceat(several[order], starts))
    out = np.empty(len(short), bool)
    out[order] = np.repeat(hit, count)
    return blocks.split(out, sizes)


class Repeats:
    """Round 2 of a chunk: the windows around hits, by distinct window."""

    def __init__(self, chunk: Chunk, bits: int):
        self.words = words = Words(chunk)
        anchors = Anchors(words)
        hit = blocks.read_bits(anchors.keys, chunk.answers("first", ANCHORS), bits)
        self.copy = blocks.repeated_texts(chunk, "first", TEXTS, bits)
        hits_before = np.zeros(len(words.hash) + 1, np.int64)
        if len(anchors.at):
            mark = np.zeros(len(words.hash), np.int64)
            mark[anchors.at] = hit[anchors.key_of]
            hits_before[1:] = np.cumsum(mark)
        at = words.whole(WINDOW)
        near = hits_before[at + WINDOW - BLOCK + 1] > hits_before[at]
        self.at = at[near & ~self.copy[words.doc[at]]]
        h, check = self._digests(chunk)
        order, starts = blocks.groups(h, check)
        self.keys, self.checks = h[order[starts]], check[order[starts]]
        self.key_of = np.empty(len(h), np.int64)
        self.key_of[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(h)]))
        ids = chunk.ids[words.doc[self.at]]
        self.ids = ids
        self.least = np.minimum.reduceat(ids[order], starts) if len(ids) else ids

    def _digests(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Two halves of the digest of each window's octets."""
        plain = b" ".join(chunk.data.split())
        size = self.words.stop - self.words.start
        begin = np.cumsum(size + 1) - (size + 1)
        ends = begin[self.at + WINDOW - 1] + size[self.at + WINDOW - 1]
        raw = b"".join(blake2b(plain[a:b], digest_size=16).digest() for a, b in zip(begin[self.at].tolist(), ends.tolist()))
        halves = np.frombuffer(raw, "<u8").reshape(-1, 2)
        return halves[:, 0].copy(), halves[:, 1].copy()


def _emit_repeats(bits: int):
    def run(batches: Iterator) -> Iterator:
        for chunk in blocks.rows_of(batches):
            r = Repeats(chunk, bits)
            base = r.least.min() if len(r.least) else 0
            offset = r.least.view(np.uint64) - np.int64(base).view(np.uint64)
            kind = "<u4" if not len(offset) or offset.max() < 1 << 32 else "<u8"
            head = np.array([base, int(kind[2])], dtype="<i8").tobytes()
            out = [
                (b, REPEATS, r.keys[p].tobytes() + r.checks[p].tobytes(), head + offset[p].astype(kind).tobytes())
                for b, p in blocks.slices(r.keys, bits)
            ]
            yield blocks.blob_batch(out, chunk.slot, chunk.chunk)

    return run


def _judge_repeats(keys: list[bytes], extra: list[bytes]) -> list[np.ndarray]:
    """Of each key: has a document elsewhere, smaller than the chunk's smallest, the window?"""
    sizes = [len(k) // 16 for k in keys]
    h = np.concatenate([np.frombuffer(k, "<u8", n) for k, n in zip(keys, sizes)])
    check = np.concatenate([np.frombuffer(k, "<u8", n, 8 * n) for k, n in zip(keys, sizes)])
    ids = []
    for e in extra:
        base, width = np.frombuffer(e, "<i8", 2)
        offset = np.frombuffer(e, f"<u{width}", -1, 16).astype(np.uint64)
        ids.append((offset + np.int64(base).view(np.uint64)).view(np.int64))
    ids = np.concatenate(ids)
    order, starts = blocks.groups(h, check)
    least = np.minimum.reduceat(ids[order], starts)
    out = np.empty(len(ids), bool)
    out[order] = np.repeat(least, np.diff(np.r_[starts, len(ids)])) < ids[order]
    return blocks.split(out, sizes)


def _remove(bits: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for chunk in blocks.rows_of(batches):
            r = Repeats(chunk, bits)
            words = r.words
            earlier = blocks.read_bits(r.keys, chunk.answers("second", REPEATS), bits)
            gone = r.at[earlier[r.key_of] | (r.ids > r.least[r.key_of])]
            cover = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + WINDOW, -1)
            removed = np.cumsum(cover)[:-1] > 0
            whole = r.copy & (words.count >= WINDOW)
            removed |= whole[words.doc]
            kept, n_removed, spans = [], [], []
            for i, (first, n) in enumerate(zip(words.first.tolist(), words.count.tolist())):
                mine = removed[first:first + n]
                lost = int(mine.sum())
                text = chunk.text(i).split()
                if lost:
                    edge = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
                    spans.append([{"start": a, "stop": b} for a, b in edge.reshape(-1, 2).tolist()])
                    text = compress(text, (~mine).tolist())
                else:
                    spans.append([])
                kept.append(b" ".join(text))
                n_removed.append(lost)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(chunk.row["ids"], pa.int64()), pa.array(words.count), pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string(), safe=False),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    chunk.rest(),
                ],
                ["doc_id", "n_words", "n_removed", "kept", "spans", "rest"],
            )

    return run


def remove_repeats(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text) -> one row each: doc_id, n_words, n_removed, kept (words joined by one
    space), spans (maximal removed runs, in words).

    Columns named in ``carry`` come back as the struct ``rest``. A null text has no words; a null id comes after all others; rows of one id do not remove
    from each other; other columns are ignored; no rows give no rows."""
    spark = docs.sparkSession
    bits = blocks.bucket_bits(spark)
    table = blocks.chunk_table(docs, carry)
    first = blocks.exchange(
        table.mapInArrow(_emit_anchors(bits), blocks.BLOB), {ANCHORS: _judge_anchors, TEXTS: blocks.judge_digests}
    )
    first = written(first, "anchors").withColumnRenamed("answers", "first")
    met = table.join(first, "slot", "left")
    second = blocks.exchange(met.mapInArrow(_emit_repeats(bits), blocks.BLOB), {REPEATS: _judge_repeats})
    second = written(second, "repeats").withColumnRenamed("answers", "second")
    return met.join(second, "slot", "left").mapInArrow(_remove(bits), blocks.with_rest(ROWS, docs, carry))


def op2_substring(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").alias("n_spans")
    )
