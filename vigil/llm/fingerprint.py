"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A document is the multiset of its paragraphs (newline-separated). Each paragraph hashes to a
wide vector; a document's fingerprint is the sum of its paragraphs' vectors, lane by lane,
modulo powers of two. Equal multisets have equal fingerprints in any order, and a
paragraph is inserted or deleted by adding or subtracting its vector.

The vector of a paragraph has

    identity   8 lanes modulo 2^32, from a keyed 256-bit hash of the paragraph
    phrases    1 lane modulo 2^32: how many phrases it has (split at . , ; : ! ?; a phrase
               over LONG_PHRASE octets is cut further where its own octets say so)
    strata     LEVELS x LANES lanes modulo 2^8: each phrase adds an odd number to one lane
               of one level; level j takes a phrase with probability 2^-(j+1), the last
               level the rest

The difference of two fingerprints is the fingerprint of what differs, so its occupied strata
lanes estimate how many phrases differ (linear counting, on the densest levels that are not
full). Likeness = 1 - differing / phrases of both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm import blocks
from vigil.llm.common import by_id, documents, written

IDENTITY = 8
LEVELS, LANES = 28, 32  # the sparsest level takes one phrase of 2^27: no text fills it
FULL = 0.75  # a level with a larger share of occupied lanes counts as full
HEAD = 4 * (IDENTITY + 1)
WIDTH = HEAD + LEVELS * LANES
PHRASE_END = rb"[.,;:!?]"
LONG_PHRASE = 192
CUT_BY = 8  # octets whose hash decides on a cut behind them
CUT_BITS = 5  # one place of 2^5
LONGEST_UNIT = 1024  # where no place is chosen
HASHED_TOGETHER = 1 << 15


def units(phrase: bytes) -> list[bytes]:
    """A long phrase (lists of words, scripts with other punctuation) in pieces cut by content: an edit
    changes the pieces around it only."""
    octets = np.frombuffer(phrase, np.uint8)
    word, f = blocks.random_words(256, 9), blocks.random_words(3, 10)
    cuts = []
    for at in range(0, len(octets), HASHED_TOGETHER):
        h = word[octets[at:at + HASHED_TOGETHER + CUT_BY - 1]]
        if len(h) < CUT_BY:
            break
        h = h[:-1] * f[0] + h[1:]
        h = h[:-2] * f[1] + h[2:]
        h = blocks.mixed(h[:-4] * f[2] + h[4:])
        cuts.append(np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + at + CUT_BY)
    out, begin = [], 0
    for stop in [*np.concatenate(cuts).tolist(), len(phrase)]:
        out += [phrase[a:min(a + LONGEST_UNIT, stop)] for a in range(begin, stop, LONGEST_UNIT)]
        begin = stop
    return out


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """(n, WIDTH) octets: the fingerprints of whole texts."""
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    n = len(texts)
    out = np.zeros((n, WIDTH), np.uint8)
    if not n:
        return out
    split = re.compile(PHRASE_END).split
    digests, para_count, hashes, phrase_count = [], [], [], []
    for text in texts:
        paragraphs = text.split(b"\n")
        for p in paragraphs:
            digests.append(xxh3_128_digest(p, 1))
            digests.append(xxh3_128_digest(p, 2))
        para_count.append(len(paragraphs))
        phrases = []
        for p in paragraphs:
            for f in split(p):
                if s := f.strip():
                    phrases += units(s) if len(s) > LONG_PHRASE else (s,)
        hashes += [xxh3_64_intdigest(s, 3) for s in phrases]
        phrase_count.append(len(phrases))
    para_count, phrase_count = np.array(para_count), np.array(phrase_count)
    lanes = np.frombuffer(b"".join(digests), dtype="<u4").reshape(-1, IDENTITY)
    begin = np.cumsum(para_count) - para_count  # every text has a paragraph
    identity = np.add.reduceat(lanes, begin, axis=0, dtype=np.uint32)
    out[:, :4 * IDENTITY] = identity.astype("<u4").view(np.uint8).reshape(n, -1)
    out[:, 4 * IDENTITY:HEAD] = phrase_count.astype("<u4").view(np.uint8).reshape(n, 4)
    h = np.array(hashes, dtype=np.uint64)
    low = (h & np.uint64((1 << LEVELS) - 1)) | np.uint64(1 << (LEVELS - 1))
    level = np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64)  # trailing zeros
    lane = (h >> np.uint64(32)).astype(np.int64) & (LANES - 1)  # other bits than the level's
    value = ((h >> np.uint64(40)) & np.uint64(255)).astype(np.int64) | 1
    at = np.repeat(np.arange(n), phrase_count) * (LEVELS * LANES) + level * LANES + lane
    strata = np.bincount(at, weights=value, minlength=n * LEVELS * LANES).astype(np.int64)
    out[:, HEAD:] = (strata & 255).astype(np.uint8).reshape(n, -1)
    return out


def _lanes(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.ascontiguousarray(f[..., :HEAD]).view("<u4"), f[..., HEAD:]


def combine(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """Fingerprints of the multisets joined (sign 1), or of ``a`` without ``b`` (sign -1)."""
    (wide_a, small_a), (wide_b, small_b) = _lanes(a), _lanes(b)
    wide = wide_a + wide_b if sign > 0 else wide_a - wide_b
    small = small_a + small_b if sign > 0 else small_a - small_b
    return np.concatenate([wide.view(np.uint8).reshape(*a.shape[:-1], HEAD), small], axis=-1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for rows of two fingerprint arrays; 1 exactly if the fingerprints are equal."""
    equal = (a == b).all(axis=1)
    both = (_lanes(a)[0][:, IDENTITY].astype(np.float64) + _lanes(b)[0][:, IDENTITY])
    occupied = (combine(a, b, -1)[:, HEAD:] != 0).reshape(len(a), LEVELS, LANES).sum(axis=2)
    counted = -LANES * np.log(1 - np.minimum(occupied, FULL * LANES) / LANES)  # a full level is never read
    differing = both.copy()
    open_ = np.ones(len(a), bool)  # levels from the sparsest down, until one is full
    above = np.zeros(len(a))
    for level in range(LEVELS - 1, -1, -1):
        open_ &= occupied[:, level] <= FULL * LANES
        above = np.where(open_, above + counted[:, level], above)
        differing = np.where(open_, above * 2.0**level, differing)
    share = np.clip(1 - differing / np.maximum(both, 1), 0, 1 - 1e-9)
    return np.where(equal, 1.0, np.where(both == 0, 0.0, share))


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of ``following``'s start."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


ROWS = (
    "kind string, shard int, doc_id long, text string, n_chars long, edited_sha256 string, "
    "fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
)


def _rows(pairs: list[tuple[int | None, str, str]]):
    """Result columns of (doc_id, text, next text)."""
    import hashlib

    encode = lambda s: s.encode("utf-8", "surrogatepass")
    changed = [encode(edited(t, f)) for _, t, f in pairs]
    # the next text is mostly the next row's own text
    own = fingerprints([encode(t) for _, t, _ in pairs] + [encode(pairs[-1][2])])
    new = fingerprints(changed)
    return {
        "doc_id": [i for i, _, _ in pairs], "n_chars": [len(t) for _, t, _ in pairs],
        "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed],
        "fingerprint": [f.tobytes() for f in own[:-1]], "edited_fingerprint": [f.tobytes() for f in new],
        "near_edited": likeness(own[:-1], new).tolist(), "near_next": likeness(own[:-1], own[1:]).tolist(),
    }


def _batch(rows: dict, kind: str, shard: int, text: str | None = None):
    import pyarrow as pa

    n = len(rows["doc_id"])
    null = [None] * n
    columns = {
        "kind": pa.array([kind] * n), "shard": pa.array([shard] * n, pa.int32()),
        "doc_id": pa.array(rows["doc_id"], pa.int64()), "text": pa.array([text] * n, pa.string()),
        "n_chars": pa.array(rows.get("n_chars", null), pa.int64()),
        "edited_sha256": pa.array(rows.get("edited_sha256", null), pa.string()),
        "fingerprint": pa.array(rows.get("fingerprint", null), pa.binary()),
        "edited_fingerprint": pa.array(rows.get("edited_fingerprint", null), pa.binary()),
        "near_edited": pa.array(rows.get("near_edited", null), pa.float64()),
        "near_next": pa.array(rows.get("near_next", null), pa.float64()),
    }
    return pa.RecordBatch.from_pydict(columns)


TEXT_AT_ONCE = 4_000_000
ROWS_AT_ONCE = 2000  # the lanes of many short texts outweigh the texts


def _sweep(batches: Iterator) -> Iterator:
    """Over ordered documents: a result row for each but the last, which waits for the next
    shard's first; so the first and the last go out as ``head`` and ``tail`` rows."""
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    held, size, last = [], 0, None
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            if last is None:
                yield _batch({"doc_id": [doc_id]}, "head", shard, text)
            else:
                held.append((*last, text))
                size += len(text)
                if size >= TEXT_AT_ONCE or len(held) >= ROWS_AT_ONCE:
                    yield _batch(_rows(held), "row", shard)
                    held, size = [], 0
            last = doc_id, text
    if held:
        yield _batch(_rows(held), "row", shard)
    if last is not None:
        yield _batch({"doc_id": [last[0]]}, "tail", shard, last[1])


def _finish(batches: Iterator) -> Iterator:
    for batch in batches:
        for r in batch.to_pylist():
            yield _batch(_rows([(r["doc_id"], r["text"] or "", r["following"] or "")]), "row", r["shard"])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint
    (octets), near_edited, near_next; one row per row. A null text is empty; null ids come last;
    rows of one id are ordered by text; the last document is followed by the first (a single
    one by itself); other columns are ignored; no rows give no rows.

    One range shuffle of the texts; shards meet in two rows each, joined afterwards."""
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(by_id(), F.xxhash64("text"))
        .sortWithinPartitions(by_id(), F.xxhash64("text"), "text")
    )
    swept = written(ordered.mapInArrow(_sweep, ROWS), "fingerprints")
    # two rows a shard: as many as there are shuffle partitions
    heads = swept.filter("kind = 'head'").select("shard", F.col("text").alias("following"))
    tails = swept.filter("kind = 'tail'").select("shard", "doc_id", "text")
    shards = heads.select(
        "shard", F.lag("shard").over(Window.orderBy("shard")).alias("before"),
        F.max("shard").over(Window.partitionBy()).alias("last"),
    )
    after = shards.select(F.coalesce("before", "last").alias("shard"), F.col("shard").alias("next_shard"))
    meeting = (
        tails.join(after, "shard")
        .join(heads.withColumnRenamed("shard", "next_shard"), "next_shard")
        .select("shard", "doc_id", "text", "following")
    )
    finished = meeting.mapInArrow(_finish, ROWS)
    return swept.filter("kind = 'row'").unionByName(finished).drop("kind", "shard", "text")


def op3_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
