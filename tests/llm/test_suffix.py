"""What travels in the removal of repeated passages: as little as its result needs."""

import numpy as np
import pyarrow as pa
import pytest

from vigil.llm import blocks, suffix


def words(rng, n):
    return "".join(chr(97 + c) for c in rng.integers(0, 26, n))


def chunk_of(texts):
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    row = {"slot": 0, "chunk": 0, "ids": list(range(len(texts))), "data": b"\n".join([*texts, b""]), "ends": ends.tolist()}
    return blocks.Chunk(row, {})


def test_texts_that_only_have_copies_send_no_strings(spark):
    rng = np.random.default_rng(1)
    own = [words(rng, 400) for _ in range(20)]
    shared = words(rng, 120)
    rows = [(i, own[i % 20]) for i in range(100)] + [(200, own[0] + shared), (201, shared + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, strings = suffix.travelling(docs, blocks.bucket_bits(spark))
    held = " ".join(bytes(r.string).decode() for r in strings.collect())
    assert shared[30:80] in held and own[0][100:150] in held  # two texts that differ have these
    assert not any(text[i:i + suffix.WINDOW] in held for text in own[1:] for i in range(0, 350, 25))
    got = {r.doc_id: (r.n_removed, [tuple(x) for x in r.spans]) for r in suffix.remove_repeats(docs).collect()}
    assert got == (
        {i: (0, []) for i in range(20)} | {i: (400, [(0, 400)]) for i in range(20, 100)}
        | {200: (400, [(0, 400)]), 201: (120, [(0, 120)])}
    )


def test_a_task_answers_a_chunk_once_for_all_its_shards():
    """Strings of 300 routes in two chunks, a shard for each few routes: one answer row a chunk."""
    rng = np.random.default_rng(2)
    texts = [words(rng, 60).encode() for _ in range(300)]
    columns = [
        pa.array(np.repeat(np.arange(300), 2)), pa.array([1, 2] * 300, pa.int32()), pa.array([1, 2] * 300),
        pa.array(np.repeat(np.arange(300), 2).astype(np.int32)), pa.array([5, 7] * 300), pa.array([t for t in texts for _ in range(2)]),
    ]
    batch = pa.RecordBatch.from_arrays(columns, ["route", "slot", "chunk", "nth", "least", "string"])
    parts = [batch.slice(a, 50) for a in range(0, 600, 50)]
    rows = [r for b in suffix._sort_shards(500, 1 << 20)(iter(parts)) for r in b.to_pylist()]
    assert [(r["slot"], r["chunk"]) for r in rows] == [(2, 2)]  # 5 is less than 7
    assert sorted(np.frombuffer(rows[0]["nths"], "<i4")) == list(range(300))
    assert (np.frombuffer(rows[0]["sizes"], "<i4") == 11).all() and rows[0]["bits"] == b"\xff\xe0" * 300


def test_minimisers_spread_over_the_buckets():
    text = words(np.random.default_rng(3), 200_000).encode()
    runs = suffix.Runs(chunk_of([text]), np.zeros(1, bool))
    held = np.bincount((runs.route >> np.uint64(60)).astype(int), minlength=16)
    assert held.max() < 1.2 * held.mean()


def test_runs_leave_copies_out():
    rng = np.random.default_rng(4)
    texts = [words(rng, n).encode() for n in (300, 20, 500, 50, 0, 90)]
    chunk, copy = chunk_of(texts), np.array([False, False, True, False, False, False])
    runs = suffix.Runs(chunk, copy)
    windows = blocks.ranges(runs.start, runs.count)
    assert sorted(windows) == [chunk.starts[i] + k for i in (0, 3, 5) for k in range(len(texts[i]) - 49)]
    assert (np.searchsorted(chunk.ends, runs.start, side="right") == runs.doc).all()
    assert not len(suffix.Runs(chunk, np.ones(6, bool)).route)


def test_runs_of_texts_that_all_have_some():
    """No run starts at what stands between two texts."""
    rng = np.random.default_rng(6)
    texts = [words(rng, n).encode() for n in rng.integers(50, 400, 300).tolist()]
    chunk = chunk_of(texts)
    runs = suffix.Runs(chunk, np.zeros(300, bool))
    windows = blocks.ranges(runs.start, runs.count)
    assert sorted(windows) == [a + k for a, t in zip(chunk.starts.tolist(), texts) for k in range(len(t) - 49)]
    assert (np.searchsorted(chunk.ends, runs.start, side="right") == runs.doc).all()


@pytest.mark.parametrize("bits", [2, 7])
def test_answers_are_read_as_given(bits):
    """Keys of three buckets: one said nothing, one once, one twice."""
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2))
    said, want = {}, np.zeros((2, 200), bool)
    for n, (bucket, part) in enumerate(blocks.slices(keys, bits)):
        flags = rng.integers(0, 2, (n % 3, part.stop - part.start)).astype(bool)
        if n % 3:
            said[bucket] = np.packbits(flags.ravel()).tobytes()
            want[:n % 3, part] = flags
    order = list(said)
    rng.shuffle(order)
    structs = [{"chunk": c, "bucket": b, "kind": k, "bits": said[b]} for b in order for c, k in ((4, 1), (4, 0), (9, 0))]
    kind = pa.struct([("chunk", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("bits", pa.binary())])
    chunk = blocks.Chunk({"slot": 0, "chunk": 4, "ids": [], "data": b"", "ends": []}, {"first": pa.array(structs, kind)[1:]})
    for nth in (0, 1):
        assert (blocks.read_bits(keys, chunk.answers("first", 0), bits, nth) == want[nth]).all()
    assert chunk.answers("first", 5) is None and not blocks.read_bits(keys, None, bits).any()
