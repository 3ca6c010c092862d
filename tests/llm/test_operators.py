"""Each operator against a brute-force version, on edge rows and on the smallest tables."""

import functools
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm import (
    blocks, fingerprint, graph, langid, mixing, packing, quality, queries, simhash, substring, suffix, tokenfile, urlfilter,
)

SF = "/root/testdata/sf0.001"
LAST = 1 << 62


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@functools.lru_cache
def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids + [2], public_tokenizers.path(name)


# ---- packing ---------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 150), max_size=60))
def test_pack_group_holds_every_token_once(lengths):
    out = packing.pack_group(lengths, 64)
    seen = defaultdict(list)
    for seq in out:
        for item, start, size in seq:
            seen[item].append((start, size))
    for item, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen[item]):
            assert start == at and size > 0
            at += size
        assert at == n
    used = [sum(p[2] for p in s) for s in out]
    assert all(0 < u <= 64 for u in used)
    assert sum(0 if u & (u - 1) == 0 else 64 - u for u in used) < 64


def test_first_fit_by_the_tournament():
    tree = packing.Tournament(5, 10)
    assert [tree.place(n) for n in (7, 6, 3, 4, 5)] == [0, 1, 0, 1, 2]


@pytest.mark.parametrize("which", ["edge", "small"])
def test_pack_ids(spark, edge, which):
    docs = edge if which == "edge" else small(spark)
    encode, path = tokenizer("word_bpe_49k.json")
    rows = packing.pack(docs, path, "word").collect()
    want = Counter((i, tuple(encode(t))) for i, t in texts(docs))
    ids_of, places = defaultdict(list), defaultdict(list)
    for r in rows:
        ids_of[r.doc_id].append((r.start, r.length, r.doc_tokens, np.frombuffer(r.ids, "<u4")))
        places[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    for pieces in places.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096
    for (i, ids), n in want.items():
        covered = Counter()
        for start, length, total, piece in ids_of[i]:
            if total == len(ids) and tuple(piece) == ids[start:start + length]:
                covered.update(range(start, start + length))
        assert all(covered[k] >= n for k in range(len(ids)))


def test_pack_nothing(empty):
    assert packing.pack(empty, tokenizer("word_bpe_49k.json")[1], "word").count() == 0


# ---- token files -----------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, (1 << 64) - 1)), max_size=400), st.integers(1, 130))
def test_simple8b_round_trip(ids, block):
    ids = np.array(ids, dtype=np.uint64)
    words, offsets, escapes = tokenfile.encode_ids(ids, block)
    assert (tokenfile.decode_ids(words, offsets, escapes, len(ids), block) == ids).all()


def test_a_block_decodes_alone():
    ids = np.arange(5000, dtype=np.uint64) % 777
    words, offsets, escapes = tokenfile.encode_ids(ids)
    part = words[offsets[2]:offsets[3]]
    assert (tokenfile.decode_ids(part, np.zeros(1, np.uint32), escapes, 1024) == ids[2048:3072]).all()


@pytest.mark.parametrize("which", ["edge", "small"])
def test_token_files_round_trip(spark, edge, which, tmp_path):
    docs = edge if which == "edge" else small(spark)
    encode, path = tokenizer("byte_bpe_50k.json")
    tokenfile.write_tokens(docs, str(tmp_path / "t"), path, "byte", page_ids=5000)
    got = sorted(tokenfile.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    want = sorted(texts(docs), key=lambda r: (LAST if r[0] is None else r[0], r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    at = 0
    for r, (_, t) in zip(got, want):
        assert (r.start, r.n_tokens) == (at, len(encode(t)))
        assert np.frombuffer(r.ids, "<u4").tolist() == encode(t)
        at += r.n_tokens


def test_token_files_of_nothing(spark, empty, tmp_path):
    tokenfile.write_tokens(empty, str(tmp_path / "t"), tokenizer("byte_bpe_50k.json")[1], "byte")
    assert tokenfile.read_tokens(spark, str(tmp_path / "t")).count() == 0


ODD = st.lists(
    st.sampled_from(list("aBz'., \n\t9é日😀́ſ\x1c\x85<|>") + ["'s", "'t", "  ", "<|endoftext|>", "word, "]), max_size=30
).map("".join)


@settings(max_examples=150, deadline=None)
@given(ODD)
def test_pieces_give_the_ids_of_the_whole(text):
    from vigil.llm.tokens import encoder

    for name, style in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        encode, path = tokenizer(name)
        assert np.frombuffer(encoder(path, style).ids(text), "<u4").tolist() == encode(text)[:-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=4))
def test_special_tokens_as_the_library_has_them(some):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer
    from vigil.llm.tokens import encoder

    some = [*some, "end <|endoftext|> of", "plain words"]
    for name, style in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        path = public_tokenizers.path(name)
        library = Tokenizer.from_file(path)
        got = encoder(path, style, special_tokens=True).many(pa.array(some, pa.string()))
        want = [library.encode(t, add_special_tokens=False).ids for t in some]
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def test_new_ascii_words_go_straight_to_the_model():
    from types import SimpleNamespace

    import public_tokenizers
    from vigil.llm.tokens import PieceEncoder

    pieces = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), "byte")
    library, calls = pieces.tokenizer, []
    encode = lambda t, **k: calls.append(t) or library.encode(t, **k)
    pieces.tokenizer = SimpleNamespace(model=library.model, encode=encode)
    text = "one unheardofword, another; \u00e9t\u00e9 doneish unheardofword."
    assert np.frombuffer(pieces.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sorted(calls) == sorted(["one", ",", ";", ".", " \u00e9t\u00e9"])
    assert " unheardofword" in pieces and " unheardofword," not in pieces


def test_words_pass_the_pretokenizer_unless_it_keeps_them(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer
    from vigil.llm.tokens import PieceEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert PieceEncoder(path, "byte").direct and not PieceEncoder(path).direct
    spec = json.loads(open(path).read())
    for name, change in (
        ("lower", {"normalizer": {"type": "Lowercase"}}),
        ("added", {"added_tokens": [*spec["added_tokens"], {**spec["added_tokens"][0], "id": spec["added_tokens"][0]["id"] + 1, "content": "Word", "special": False}]}),
    ):
        changed = str(tmp_path / f"{name}.json")
        with open(changed, "w") as f:
            json.dump({**spec, **change}, f)
        text = "Some Wording here, Words"
        pieces = PieceEncoder(changed, "byte")
        assert not pieces.direct
        assert np.frombuffer(pieces.whole(text), "<u4").tolist() == Tokenizer.from_file(changed).encode(text, add_special_tokens=False).ids


def test_queries_keep_special_tokens(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    text = "end <|endoftext|> of"
    spark.createDataFrame([(1, text), (2, "next")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ids = {n: Tokenizer.from_file(public_tokenizers.path(n)).encode(text, add_special_tokens=False).ids + [2]
           for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
    first = {r.doc_id: r for r in queries.QUERIES["op9_token_files"](spark, str(tmp_path)).collect()}
    assert first[1].ids_crc32 == zlib.crc32(np.array(ids["byte_bpe_50k.json"], "<u4").tobytes())
    assert first[2].start == len(ids["byte_bpe_50k.json"]) == 5
    packed = {r.doc_id: r.doc_tokens for r in queries.QUERIES["op1_packing"](spark, str(tmp_path)).collect()}
    assert packed[1] == len(ids["word_bpe_49k.json"])


# ---- substring and suffix array --------------------------------------------------------


def brute_windows(rows, units, window):
    """rows (id, text) -> per row the flags of removed units, judged on the input."""
    least = {}
    for i, t in rows:
        u = units(t)
        for k in range(len(u) - window + 1):
            w = u[k:k + window]
            key = w if isinstance(w, bytes) else tuple(w)
            least[key] = min(least.get(key, LAST), LAST if i is None else i)
    out = []
    for i, t in rows:
        u = units(t)
        gone = np.zeros(len(u), bool)
        for k in range(len(u) - window + 1):
            w = u[k:k + window]
            if least[w if isinstance(w, bytes) else tuple(w)] < (LAST if i is None else i):
                gone[k:k + window] = True
        out.append((i, u, gone))
    return out


def test_substring_tells_words_of_one_polynomial_hash_apart(spark):
    """Thue-Morse words and their complements collide modulo 2**64 whatever the odd base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    start = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{start} {one}"), (2, f"{start} {other}"), (3, f"{start}\n{one} end")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(docs).collect()}
    assert got == {1: (13, 0), 2: (13, 0), 3: (14, 13)}


@pytest.mark.parametrize("which", ["edge", "small"])
def test_substring_against_brute_force(spark, edge, which):
    docs = edge if which == "edge" else small(spark)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs).collect())
    want = Counter(
        (i, len(u), int(g.sum()), " ".join(x for x, lost in zip(u, g) if not lost))
        for i, u, g in brute_windows(texts(docs), words_of, substring.WINDOW)
    )
    assert got == want


@pytest.mark.parametrize("which", ["edge", "small"])
def test_suffix_array_against_brute_force(spark, edge, which):
    docs = edge if which == "edge" else small(spark)
    result = suffix.remove_repeats(docs, shard_octets=20_000, queue_octets=4_000).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept), len(r.spans)) for r in result)
    want = Counter()
    for i, u, g in brute_windows(texts(docs), lambda t: (t or "").encode(), suffix.WINDOW):
        spans = int((np.diff(np.r_[False, g].astype(int)) == 1).sum())
        want[i, len(u), int(g.sum()), np.frombuffer(u, np.uint8)[~g].tobytes(), spans] += 1
    assert got == want


def test_a_hot_minimiser_is_split(spark):
    """A phrase in every document, each time in another context: no route holds more than a shard."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    phrase = "subscribe to our newsletter for weekly news and offers"
    own = [["".join(chr(97 + c) for c in rng.integers(0, 26, 150)) for _ in range(2)] for _ in range(400)]
    rows = [(i, f"{a} {phrase} {b}") for i, (a, b) in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bits, shard = blocks.bucket_bits(spark), 4_000
    _, strings = suffix.travelling(docs, bits, shard_octets=shard)
    held = strings.select("route", "string").distinct().groupBy("route").agg(F.sum(F.length("string")))
    assert 0 < held.agg(F.max("sum(length(string))")).first()[0] <= shard
    _, whole = suffix.travelling(docs, bits)  # a shard that holds all
    held = whole.select("route", "string").distinct().groupBy("route").agg(F.sum(F.length("string")))
    assert held.agg(F.max("sum(length(string))")).first()[0] > 4 * shard
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix.remove_repeats(docs, shard_octets=shard).collect()}
    for i, u, gone in brute_windows(rows, str.encode, suffix.WINDOW):
        assert got[i] == (int(gone.sum()), np.frombuffer(u, np.uint8)[~gone].tobytes())


def test_dedup_of_nothing(empty):
    assert substring.remove_repeats(empty).count() == 0
    assert suffix.remove_repeats(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80), st.sampled_from([64, 1 << 30]))
def test_suffix_order(text, limit):
    text = np.array([*text, 0], np.uint16)
    want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert suffix.suffix_order(text, len(text) + 1, limit).tolist() == want


# ---- fingerprints ----------------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("ab. \n", max_size=8), min_size=1, max_size=12), st.randoms())
def test_multiset_hash(paragraphs, random):
    paragraphs = [p.replace("\n", "").encode() for p in paragraphs]
    shuffled = list(paragraphs)
    random.shuffle(shuffled)
    whole, other, head, tail = fingerprint.fingerprints(
        [b"\n".join(paragraphs), b"\n".join(shuffled), paragraphs[0], b"\n".join(paragraphs[1:])]
    )
    assert (whole == other).all()  # order does not matter
    if len(paragraphs) > 1:
        assert (fingerprint.combine(head, tail) == whole).all()  # insertion
        assert (fingerprint.combine(whole, head, -1) == tail).all()  # deletion


@pytest.mark.parametrize("which", ["edge", "small"])
def test_fingerprints_against_brute_force(spark, edge, which):
    docs = edge if which == "edge" else small(spark)
    from vigil.llm.common import by_id
    from pyspark.sql import functions as F

    order = docs.select("doc_id", "text").orderBy(by_id(), F.xxhash64("text"), "text").collect()
    rows = [(r.doc_id, r.text or "") for r in order]
    want = Counter()
    for k, (i, t) in enumerate(rows):
        following, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        changed = (t[:len(t) - half] + following[:half]).encode()
        f, e, n = fingerprint.fingerprints([t.encode(), changed, following.encode()])
        near = [float(fingerprint.likeness(f[None], x[None])[0]) for x in (e, n)]
        want[i, len(t), hashlib.sha256(changed).hexdigest(), f.tobytes(), e.tobytes(), *near] += 1
    got = Counter(
        (r.doc_id, r.n_chars, r.edited_sha256, bytes(r.fingerprint), bytes(r.edited_fingerprint), r.near_edited, r.near_next)
        for r in fingerprint.fingerprint_documents(docs).collect()
    )
    assert got == want


def test_likeness_and_single_documents(spark, empty):
    base = [f"phrase {i} of many" for i in range(400)]
    half = base[:200] + [f"another {i}" for i in range(200)]
    f = fingerprint.fingerprints([". ".join(base).encode(), ". ".join(half).encode()])
    assert fingerprint.likeness(f[:1], f[:1])[0] == 1
    assert abs(fingerprint.likeness(f[:1], f[1:])[0] - 0.5) < 0.25
    assert fingerprint.fingerprint_documents(empty).count() == 0
    one = spark.createDataFrame([(7, "alone. here")], "doc_id long, text string")
    assert fingerprint.fingerprint_documents(one).first().near_next == 1.0


@pytest.mark.parametrize("shared", [0, 100_000, 180_000])
def test_likeness_of_long_texts(shared):
    """Against the true overlap: 200,000 phrases each, so up to 400,000 differ."""
    n = 200_000
    a = ". ".join(f"phrase {i} of many" for i in range(n))
    b = ". ".join(f"phrase {i} of many" for i in range(n - shared, 2 * n - shared))
    f = fingerprint.fingerprints([a.encode(), b.encode()])
    assert abs(fingerprint.likeness(f[:1], f[1:])[0] - shared / n) < 0.25


def test_likeness_without_phrase_ends():
    """Texts that are one phrase by ASCII punctuation: half shared, and nothing shared."""
    rng = np.random.default_rng(8)
    words = [" ".join(f"word{i}" for i in rng.integers(0, 1 << 40, 3000)) for _ in range(3)]
    japanese = ["".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 6000)).replace(chr(0x5000), "。") for _ in range(3)]
    for first, second, third in (words, japanese):
        f = fingerprint.fingerprints([t.encode() for t in (first + second, first + third, second, third)])
        assert abs(fingerprint.likeness(f[:1], f[1:2])[0] - 0.5) < 0.25
        assert fingerprint.likeness(f[2:3], f[3:])[0] < 0.25
    assert b"".join(fingerprint.units(b"a" * 100_000)) == b"a" * 100_000
    assert max(map(len, fingerprint.units(b"a" * 100_000))) <= fingerprint.LONGEST_UNIT


# ---- SimHash ---------------------------------------------------------------------------


def brute_simhash(text):
    from xxhash import xxh64_intdigest

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words_of(lowered)
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("which", ["edge", "small"])
def test_simhash_against_brute_force(spark, edge, which):
    docs = edge if which == "edge" else small(spark)
    rows = [(i, brute_simhash(t)) for i, t in texts(docs)]
    codes = sorted({c for _, c in rows})
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for x, a in enumerate(codes):
        for b in codes[x + 1:]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, c in rows:
        if i is not None:
            least[find(c)] = min(least.get(find(c), LAST), i)
    want = Counter((i, c, least.get(find(c))) for i, c in rows)
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_groups(docs).collect())
    assert got == want
    kept = simhash.first_of_groups(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({find(c) for _, c in rows})


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(0, 4), st.integers(2, 9))
def test_gray_index_finds_all_links(seed, distance, fanout):
    rng = np.random.default_rng(seed)
    codes = np.repeat(rng.integers(0, 1 << 63, 6, dtype=np.uint64), 12)
    for _ in range(4):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, len(codes)).astype(np.uint64))
    codes = np.unique(codes)
    group = rng.integers(0, 2, len(codes))
    a, b = simhash.GrayIndex(group, codes, fanout).links(distance)
    want = {
        (i, j) for i in range(len(codes)) for j in range(i + 1, len(codes))
        if group[i] == group[j] and int(codes[i] ^ codes[j]).bit_count() <= distance
    }
    assert sorted((min(x), max(x)) for x in zip(a.tolist(), b.tolist())) == sorted(want)


def test_routes_share_a_key_within_the_distance():
    masks = [m & (1 << 64) - 1 for m in simhash.route_masks(2)]
    rng = np.random.default_rng(2)
    for _ in range(300):
        flips = rng.integers(0, 64, 2).tolist()
        change = sum(1 << f for f in set(flips))
        assert any(change & m == 0 for m in masks)


def test_components_of_a_path_and_none(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in graph.components(path).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert graph.components(path.limit(0)).count() == 0


def test_simhash_of_nothing(empty):
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.first_of_groups(empty).count() == 0


# ---- URL filter ------------------------------------------------------------------------


def test_url_filter_intervals_and_precedence(spark):
    entries = spark.createDataFrame(
        [
            ("host", "a.x.org", "2024-01-10", "block"), ("host", "a.x.org", "2024-02-10", "lift"),
            ("domain", "x.org", "2024-01-20", "block"), ("path", "a.x.org/ok", "2024-01-05", "allow"),
            ("host", "b.x.org", "2024-03-01", "lift"), ("host", "b.x.org", "2024-03-01", "block"), ("host", None, "2024-01-01", "block"),
        ],
        "grain string, rule string, day string, state string",
    ).selectExpr("grain", "rule", "to_date(day) AS day", "state")
    cases = [
        (1, "http://a.x.org/p", "2024-01-09", False), (2, "http://a.x.org/p", "2024-01-10", True),
        (3, "http://u:p@A.X.org:80/p?q", "2024-02-09", True), (4, "http://a.x.org/p", "2024-02-10", True),  # by its domain
        (5, "https://a.x.org/ok/z", "2024-01-15", False), (6, "http://b.x.org/", "2024-03-02", True),
        (7, None, "2024-03-02", False), (8, "", "2024-03-02", False), (9, "nonsense", None, False),
        (2, "http://a.x.org/p", "2024-01-10", True),
    ]
    captures = spark.createDataFrame([c[:3] + ("x",) for c in cases], "id long, url string, day string, rule string").selectExpr(
        "id", "url", "to_date(day) AS fetched", "rule"
    )
    got = {r.id: r.blocked for r in urlfilter.judge(captures, entries).collect()}
    assert got == {c[0]: c[3] for c in cases}
    assert urlfilter.judge(captures.limit(0), entries).count() == 0
    assert not any(r.blocked for r in urlfilter.judge(captures, entries.limit(0)).collect())


def test_url_hosts_and_domains(spark):
    cases = [
        ("http://192.168.0.1/a", "192.168.0.1", None), ("http://10.9.0.1:8080/", "10.9.0.1", None),
        ("http://[::1]:80/x", "[::1]", None), ("http://[2001:DB8::a.b]/", "[2001:db8::a.b]", None),
        ("https://evil.com./x", "evil.com", "evil.com"), ("https://www.Evil.com", "www.evil.com", "evil.com"),
        ("http://bbc.co.uk/", "bbc.co.uk", "bbc.co.uk"), ("http://news.bbc.co.uk/", "news.bbc.co.uk", "bbc.co.uk"),
        ("http://co.uk/", "co.uk", None), ("http://localhost/", "localhost", None), ("http://a.b.co.com/", "a.b.co.com", "co.com"),
        ("http://u:p@x.org.au/", "x.org.au", "x.org.au"), ("nonsense", "", None), (None, None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id long, url string")
    keys = urlfilter.rule_keys(F.col("url"))
    rows = df.select("id", urlfilter.host_of(F.col("url")).alias("host"), keys["domain"].alias("domain")).orderBy("id").collect()
    assert [(r.host, r.domain) for r in rows] == [c[1:] for c in cases]


def test_url_rules_do_not_reach_strangers(spark):
    entries = spark.createDataFrame(
        [("host", "192.168.0.1"), ("domain", "bbc.co.uk"), ("domain", "evil.com"), ("domain", "0.1"), ("domain", "co.uk")], "grain string, rule string"
    ).selectExpr("grain", "rule", "DATE'2024-01-01' AS day", "'block' AS state")
    urls = ["http://192.168.0.1/", "http://10.9.0.1/", "http://news.bbc.co.uk/", "http://itv.co.uk/", "http://evil.com./", "http://[::1]/"]
    captures = spark.createDataFrame(list(enumerate(urls)), "id long, url string").selectExpr("id", "url", "DATE'2024-02-01' AS fetched")
    got = {r.id: r.blocked for r in urlfilter.judge(captures, entries).collect()}
    assert [got[i] for i in range(len(urls))] == [True, False, True, False, True, False]


# ---- language --------------------------------------------------------------------------


def test_spellings_of_a_language_are_one_class(spark):
    tags = ["fr", "FR", "fr-CA", "fr_BE", " fr "]
    rows = [(i, "la les des que pour dans une est " * 4, tags[i % 5]) for i in range(20)]
    rows += [(100 + i, "der die das und nicht ist ein mit " * 4, "de") for i in range(20)] + [(200, "blank tag", "  "), (201, "no tag", None)]
    languages, table = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert languages == ["de", "fr"] and table.shape[1] == 2
    plain, same = langid.fit(spark.createDataFrame([(i, t, l and l.strip()[:2].lower()) for i, t, l in rows], "doc_id long, text string, lang string"))
    assert plain == languages and np.array_equal(table, same)  # spelling changes nothing


def test_language_held_out(spark):
    import duckdb

    languages, table = langid.fit(small(spark))
    rows = duckdb.sql("SELECT text, lang FROM '/root/testdata/sf0.01/documents.parquet' WHERE doc_id >= 200").fetchall()
    guess = langid.text_scores([t for t, _ in rows], table).argmax(axis=1)
    assert np.mean([languages[g] == lang for g, (_, lang) in zip(guess, rows)]) > 0.97


def test_language_evidence(spark, edge, empty):
    model = langid.fit(small(spark))
    schema = "doc_id long, page_id long, text string, html string, declared string, suffix string, domain string, host string"
    french = [(i, None, "la les des que pour dans une est " * 4, None, "fr", "fr", "x.fr", "h.x.fr") for i in range(30)]
    doubt = [(99, None, None, None, "fr", "fr", "x.fr", "h.x.fr"), (98, None, "", None, None, None, None, None)]
    page = [(None, 5, None, '<html lang="DE"><script>les des</script><p>und der die das nicht ist</p>', None, "", None, None)]
    got = langid.identify(spark.createDataFrame(french + doubt + page, schema), *model).collect()
    by_id = {r.doc_id: r for r in got}
    assert by_id[99].lang == "fr" and by_id[99].text_lang is None  # by its tag, suffix and host
    assert 0 < by_id[98].probability <= 1 and by_id[98].lang is not None
    assert by_id[None].lang == "de" and by_id[None].declared == "de"
    assert langid.identify(spark.createDataFrame([], schema), *model).count() == 0
    assert langid.fit(empty)[0] == []
    assert langid.identify(spark.createDataFrame(page, schema), *langid.fit(empty)).first().lang is None


def test_declared_tags_by_primary_subtag(spark):
    model = langid.fit(small(spark))
    schema = "doc_id long, page_id long, text string, html string, declared string, suffix string, domain string, host string"
    tags = ["fr", "fr-FR", "FR_ca", " fr "]
    french = [(i, None, "la les des que pour dans une est " * 4, None, tags[i % 4], None, None, None) for i in range(30)]
    named = [(100 + i, None, "der die das und nicht ist ein mit " * 4, None, "german", None, None, None) for i in range(30)]
    doubt = [(98, None, "", None, "fr-BE", None, None, None), (99, None, "", None, "German", None, None, None)]
    page = [(None, 5, None, '<html dir="ltr" lang="fr-CA"><p></p>', None, None, None, None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(french + named + doubt + page, schema), *model).collect()}
    assert (got[98].declared, got[98].lang) == ("fr", "fr")
    assert (got[99].declared, got[99].lang) == ("german", "de")
    assert (got[None].declared, got[None].lang) == ("fr", "fr")
    assert {got[i].declared for i in range(30)} == {"fr"}
    assert [langid.primary(t) for t in (None, " ", "zh-Hans", "x-own", "日本")] == ["", "", "zh", "x-own", "日本"]


# ---- quality ---------------------------------------------------------------------------


def brute_statistics(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often, cover = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            cover |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def test_quality_against_brute_force(spark, edge, empty):
    docs = small(spark)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for rows in (docs, edge):
        judged = quality.quality_rules(rows, labels, docs).collect()
        got = Counter((r.doc_id, *[r["__quality"][c] for c in quality.COUNTS], r["__quality"].base_failed) for r in judged)
        want = Counter()
        for i, t in texts(rows):
            s = brute_statistics(t)
            want[i, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]] += 1
        assert got == want
    assert quality.quality_rules(empty, labels, docs).count() == 0
    alone = quality.quality_rules(docs, labels.limit(0)).collect()  # no labels: the base rules decide
    assert all(r["__quality"].kept != r["__quality"].base_failed for r in alone)


def test_trees_learn_and_keep_directions():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (rng.random(3000) < 0.05)).astype(float)
    trees = quality.train(x[:2000], y[:2000], [1, -1, 0])
    margin = trees.margin(x[2000:])
    assert np.mean((margin > 0) == (y[2000:] > 0)) > 0.9
    grid = np.linspace(-3, 3, 50)
    for j, direction in ((0, 1), (1, -1)):
        for row in x[2000:2020]:
            probe = np.tile(row, (50, 1))
            probe[:, j] = grid
            assert (np.diff(trees.margin(probe)) * direction >= -1e-9).all()


def test_quality_held_out(spark):
    import pandas as pd

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = quality.labelled_statistics(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    train, test = table[table.doc_id % 2 == 0], table[table.doc_id % 2 == 1]
    verdict = quality.fit(pd.DataFrame(train))
    kept = verdict.trees.margin(quality.feature_matrix(test)) >= verdict.threshold
    assert kept[test.quality == 1].mean() > 0.97 and kept[test.quality == 0].mean() < 0.3


# ---- mixing ----------------------------------------------------------------------------


def test_targets_fill_to_their_caps(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 490), ("z", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # weights a 5, b 2, c 1, z 5, null 2; a and z stand at three times their sizes
    assert got["a"] == 30 and got["z"] == 0 and abs(sum(got.values()) - 2000) < 1e-6
    assert abs(got["b"] / got["c"] - 2) < 1e-9 and abs(got["b"] - got[None]) < 1e-9


def test_mix_on_edge_rows(spark, edge, empty):
    plan = mixing.mix(edge).collect()
    assert all(0 <= r.copies <= 3 for r in plan)
    assert all(r.copies == 0 for r in plan if r.size == 0) or all(r.target >= 0 for r in plan)
    taken = defaultdict(int)
    n = Counter((i, t or "") for i, t in texts(edge))
    for r in plan:
        taken[r.source] += r.size * r.copies * max(c for (i, t), c in n.items() if i == r.doc_id and len(words_of(t)) == r.size)
    target = {r.source: r.target for r in plan}
    assert all(taken[s] <= target[s] + 1e-6 for s in target)
    again = mixing.mix(edge.repartition(5)).collect()
    assert sorted(map(repr, plan)) == sorted(map(repr, again))
    out = mixing.mixed(edge)
    assert out.columns == edge.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_equal_rows_are_taken_one_by_one(spark, tmp_path):
    """A source of 40 equal rows meets its target up to less than a row, as in the SQL twin."""
    import duckdb

    rows = [(1, "ten words " * 5, "a")] * 40 + [(None, "five words in this text", None)] * 30
    rows += [(i, f"text {i} " * 5, "b") for i in range(2, 62)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    target = {r.source: r.target for r in mixing.mix(docs).collect()}
    taken = Counter()
    for r in mixing.mixed(docs).collect():
        taken[r.source] += len(words_of(r.text))
    assert mixing.mixed(docs).columns == docs.columns
    assert all(target[s] - 10 < taken[s] <= target[s] for s in target), (target, taken)
    df = queries.QUERIES["op10_mixing"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(queries.ORACLE_SQL["op10_mixing"]).fetchall()
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(map(repr, want))


def test_many_sources_and_few_give_one_mix(spark, edge, monkeypatch):
    """Beyond the size that is broadcast, salted joins give the same plan; below it, no row moves by source."""
    few = sorted(map(repr, mixing.mix(edge).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    monkeypatch.setattr(mixing, "SALTS", 3)
    assert sorted(map(repr, mixing.mix(edge).collect())) == few
    hot = spark.range(300).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text_hash", "CAST(id % 2 AS STRING) AS source")
    one = spark.createDataFrame([("0", 1)], "source string, k int")
    plan = mixing._attached(hot, one, True, "source")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert mixing._attached(hot, one, False, "source").columns == mixing._attached(hot, one, True, "source").columns


# ---- registered queries ----------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twin(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == sorted(repr(r) for r in result.fetchall())


def test_queries_digest_the_operators(spark):
    """The queries without a twin: their digests of ids against the tokenizers."""
    docs = dict(texts(small(spark)))
    encode, _ = tokenizer("word_bpe_49k.json")
    for r in queries.QUERIES["op1_packing"](spark, SF).collect():
        ids = np.array(encode(docs[r.doc_id])[r.start:r.start + r.length], "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32
    encode, _ = tokenizer("byte_bpe_50k.json")
    for r in queries.QUERIES["op9_token_files"](spark, SF).collect():
        assert zlib.crc32(np.array(encode(docs[r.doc_id]), "<u4").tobytes()) == r.ids_crc32


def test_chunks_hold_whole_texts(spark, edge):
    rows = blocks.chunk_table(edge, ["source"], octets=2000).collect()
    got = Counter()
    for r in rows:
        at = 0
        for i, end, rest in zip(r.ids, r.ends, r.rest):
            got[i, bytes(r.data[at:end]).decode(), rest.source] += 1
            at = end + 1
    assert got == Counter((r.doc_id, r.text or "", r.source) for r in edge.collect())
