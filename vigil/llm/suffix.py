"""Suffix-array deduplication of whole texts as octets, by induced sorting of small shards in memory.

A window of WINDOW octets is removed where it also starts in a document with a smaller id.

Shards. Equal windows must meet in one shard. A window's minimiser, its least hash of GRAM
octets, depends on its content alone, so windows are routed by it: consecutive windows with
one minimiser travel as one string. First digests of whole texts are exchanged: a text equal to
an earlier one repeats whole and takes no further part. Then the minimisers themselves are exchanged as packed
keys (see ``blocks``): a minimiser that only one document has cannot be that of a shared
window, and its strings stay home. Equal strings of a chunk travel once, with their least id.
A shard is any set of routes, so shards are cut to SHARD_OCTETS.

Hot minimisers. A frequent phrase longer than GRAM has windows that reach into each document's own
context: one string per document, all under one minimiser. The exchange of minimisers adds up
the octets of each one's strings; where they exceed a shard, the strings are broken into single
windows, routed by the hash of the whole window. Equal windows have one minimiser, so they are
broken everywhere or nowhere and still meet; a chunk sends each distinct one once.

Sorting. A shard's distinct strings are suffix-sorted by induced sorting: LMS substrings are
sorted by one induction, named, and their suffixes ordered by recursion on the names (again by
induction while the names are few; otherwise by rank doubling as far as a window reaches); a
second induction orders all suffixes. The priority queue of the induction holds suffixes by
first character, first in first out within one, which is the order of the suffixes that
follow; its arrays go to disk beyond QUEUE_OCTETS, which a shard of SHARD_OCTETS never reaches. Suffixes that share a window are
neighbours then; common prefixes are compared up to the window, eight octets at a time, and
the least id of each group answers all of its windows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import blocks
from vigil.llm.blocks import Chunk
from vigil.llm.common import documents, written

WINDOW = 50
GRAM = 24
LONGEST = 256  # windows per travelling string
HASHED_TOGETHER = 1 << 14  # windows hashed at once: their arrays fit a core's cache
SHARD_OCTETS = 1_000_000  # what the sort works on at once: small enough for a core's cache
QUEUE_OCTETS = 256_000_000
ANSWERED_TOGETHER = 1 << 19  # strings whose answers a task gathers, so that a chunk gets few rows
FEW_NAMES = 2048
STRING_OCTETS = LONGEST + WINDOW - 1  # a travelling string's at most
GRAMS, TEXTS = 0, 1


# ---- induced sorting -------------------------------------------------------------------


class Queues:
    """First-in-first-out arrays of suffixes by first character, on disk beyond a limit."""

    def __init__(self, kind: np.dtype, limit: int = QUEUE_OCTETS):
        self.kind, self.limit, self.held, self.parts, self.files = kind, limit, 0, {}, {}

    def push(self, suffixes: np.ndarray, chars: np.ndarray) -> None:
        if not len(suffixes):
            return
        order = np.argsort(chars, kind="stable")
        ranked, chars = suffixes[order], chars[order]
        begin = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
        border = [*begin.tolist(), len(ranked)]
        for c, a, b in zip(chars[begin].tolist(), border, border[1:]):
            self.parts.setdefault(c, []).append(ranked[a:b])
        self.held += suffixes.nbytes
        if self.held > self.limit:
            for c, parts in self.parts.items():
                if c not in self.files:
                    self.files[c] = tempfile.TemporaryFile()
                for part in parts:
                    self.files[c].write(part.tobytes())
            self.parts, self.held = {}, 0

    def pop(self, char: int) -> np.ndarray:
        parts = self.parts.pop(char, [])
        self.held -= sum(p.nbytes for p in parts)
        if char in self.files:
            with self.files.pop(char) as file:
                file.seek(0)
                parts.insert(0, np.frombuffer(file.read(), self.kind))
        return np.concatenate(parts) if parts else np.zeros(0, self.kind)


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (the last one too)."""
    differ = np.flatnonzero(text[1:] != text[:-1])
    out = np.ones(len(text), bool)
    if len(differ):
        out[:differ[-1] + 1] = np.repeat(text[differ] < text[differ + 1], np.diff(np.r_[-1, differ]))
    return out


def _induce(text: np.ndarray, small: np.ndarray, stars: np.ndarray, limit: int) -> np.ndarray:
    """All suffixes in order, from the order of the LMS suffixes ``stars``."""
    n, kind = len(text), stars.dtype
    queues = Queues(kind, limit)
    first = text[stars]
    begin = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
    star_of = dict(zip(first[begin].tolist(), np.split(stars, begin[1:])))
    chars = np.flatnonzero(np.bincount(text)).tolist()
    larger: dict[int, np.ndarray] = {}
    smaller: dict[int, np.ndarray] = {}

    def closed(c: int, wanted: bool) -> list[np.ndarray]:
        """Empty the queue of ``c``, following predecessors that start with ``c`` as well."""
        cur, parts = queues.pop(c), []
        while len(cur):
            parts.append(cur)
            before = cur[cur > 0] - 1
            before = before[small[before] == wanted]
            head = text[before]
            queues.push(before[head != c], head[head != c])
            cur = before[head == c]
        return parts

    nothing = [np.zeros(0, kind)]
    for c in chars:
        larger[c] = np.concatenate(closed(c, False) or nothing)
        star = star_of.get(c)
        if star is not None:
            before = star[star > 0] - 1
            before = before[~small[before]]
            queues.push(before, text[before])
    for c in reversed(chars):
        parts = closed(c, True)
        if c == chars[0]:
            parts.append(np.array([n - 1], kind))
        smaller[c] = np.concatenate(parts or nothing)[::-1]
        cur = larger[c][::-1]
        before = cur[cur > 0] - 1
        before = before[small[before]]
        queues.push(before, text[before])
    return np.concatenate([part for c in chars for part in (larger[c], smaller[c])])


def _names(text: np.ndarray, ranked: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Names of LMS substrings in their order: equal ones share a name."""
    wide = np.r_[text, np.zeros(4, text.dtype)].astype(np.uint64)
    a, b, length = ranked[:-1], ranked[1:], size[1:]
    same = size[:-1] == size[1:]
    if text.max(initial=0) < 1 << 16:  # four characters at a time
        step = 4
        packed = (wide[:-3] << np.uint64(48)) | (wide[1:-2] << np.uint64(32)) | (wide[2:-1] << np.uint64(16)) | wide[3:]
    else:
        step, packed = 1, wide
    at, live = 0, np.flatnonzero(same)
    while len(live):
        rest = np.minimum(length[live] - at, step)
        drop = ((step - rest) * 16).astype(np.uint64)
        equal = (packed[a[live] + at] >> drop) == (packed[b[live] + at] >> drop)
        same[live[~equal]] = False
        at += step
        live = live[equal & (length[live] > at)]
    return np.cumsum(np.r_[0, ~same])


def _double(names: np.ndarray, reach: int) -> np.ndarray:
    """Order of the suffixes of ``names`` by their first ``reach`` names, by rank doubling. A rank is
    the place where its group of equals starts; only suffixes with equals are sorted again."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    new = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    count = np.diff(np.r_[new, n])
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.repeat(new, count) + 1  # 0 is the end
    place = np.flatnonzero(np.repeat(count > 1, count))  # where the open groups lie in the order
    k = 1
    while len(place) and k < reach:
        todo = order[place]
        group, after = rank[todo], rank[np.minimum(todo + k, n)]
        again = np.argsort(group * (n + 1) + after, kind="stable")
        todo, group, after = todo[again], group[again], after[again]
        order[place] = todo  # groups keep their places, sorted within
        head = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        new = np.flatnonzero(head)
        count = np.diff(np.r_[new, len(todo)])
        rank[todo] = np.repeat(place[new], count) + 1
        place = place[np.repeat(count > 1, count)]
        k *= 2
    return order


def suffix_order(text: np.ndarray, reach: int = WINDOW, limit: int = QUEUE_OCTETS) -> np.ndarray:
    """Suffixes of ``text`` (ends with its only least character, or a separator 0) in the order of at
    least their first ``reach`` characters."""
    n = len(text)
    kind = np.int32 if n < 1 << 31 else np.int64
    small = _types(text)
    star = np.flatnonzero(small & np.r_[False, ~small[:-1]]).astype(kind)
    if not len(star):  # nothing but one falling run
        return np.arange(n - 1, -1, -1, dtype=kind)
    # by first character, the end of the text first
    by_char = np.r_[star[-1:], star[:-1]]
    by_char = by_char[np.argsort(text[by_char], kind="stable")]
    order = _induce(text, small, by_char, limit)
    place = np.full(n, -1, kind)
    place[star] = np.arange(len(star), dtype=kind)
    ranked = order[place[order] >= 0]
    size = np.diff(np.r_[star, n - 1]) + 1
    names_ranked = _names(text, ranked, size[place[ranked]])
    if names_ranked[-1] + 1 < len(star):
        names = np.empty(len(star), np.int64)  # bounded by the shard
        names[place[ranked]] = names_ranked
        few = names_ranked[-1] < FEW_NAMES
        ranked = star[suffix_order(names, reach, limit) if few else _double(names, reach)]
    return _induce(text, small, ranked, limit)


def least_of_windows(
    strings: list[bytes], ids: np.ndarray, window: int = WINDOW, limit: int = QUEUE_OCTETS
) -> tuple[np.ndarray, np.ndarray]:
    """For each string, per window start: the least id of all strings that have this window. All strings
    in one array, and where each one's part begins (and the last one's ends)."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    octets = np.frombuffer(b"\x00".join([*strings, b""]), np.uint8)
    stop = np.cumsum(size + 1) - 1
    text = octets.astype(np.uint16) + 1
    text[stop] = 0
    order = suffix_order(text, window, limit)
    whole = np.zeros(len(text), bool)
    begin = stop - size
    n_windows = np.maximum(size - window + 1, 0)
    at = np.repeat(begin, n_windows) + np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    whole[at] = True
    order = order[whole[order]]
    pack = octets.astype(np.uint64)
    for shift in (1, 2, 4):
        pack = (pack[:-shift] << np.uint64(8 * shift)) | pack[shift:]
    a, b = order[:-1], order[1:]
    equal = np.ones(len(a), bool)
    for offset in [*range(0, window - 8, 8), window - 8]:
        live = np.flatnonzero(equal)
        equal[live] = pack[a[live] + offset] == pack[b[live] + offset]
    owner = np.repeat(ids, size + 1)
    out = np.empty(len(text), np.int64)
    if len(order):
        starts = np.flatnonzero(np.r_[True, ~equal])
        least = np.minimum.reduceat(owner[order], starts)
        out[order] = np.repeat(least, np.diff(np.r_[starts, len(order)]))
    return out[at], np.r_[0, np.cumsum(n_windows)]


# ---- routing ---------------------------------------------------------------------------


def _minimisers(octets: np.ndarray, word: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Of each window of ``octets``, the least hash of its GRAM octets."""
    h = h1 = word[octets]
    for k, step in enumerate([1, 2, 4, 8]):
        if step == 8:
            h8 = h
        part = h[:-step] * f[k]
        part += h[step:]
        h = part
    h = h[:-8] * f[4]
    h += h8[16:]  # GRAM octets
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    width = WINDOW - GRAM + 1
    reach = 1
    while 2 * reach <= width:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    return np.minimum(h[:len(h) - (width - reach)], h[width - reach:])


class Runs:
    """Runs of windows of a chunk that share a minimiser: route, first window, count, document. Texts
    that are ``copy`` have none."""

    def __init__(self, chunk: Chunk, copy: np.ndarray):
        self.data = chunk.data
        none = np.zeros(0, np.int64)
        self.route, self.start, self.count, self.doc = none.view(np.uint64), none, none, none
        keep = np.flatnonzero(~copy & (chunk.ends - chunk.starts >= WINDOW))
        if not len(keep):
            return
        octets, begin, end = chunk.octets, chunk.starts, chunk.ends
        if len(keep) < len(copy):  # only those that have runs, one behind the other
            octets = np.concatenate([octets[a:b] for a, b in zip(begin[keep].tolist(), end[keep].tolist())])
            end = np.cumsum((chunk.ends - chunk.starts)[keep])
            begin = np.r_[0, end[:-1]]
        least = np.empty(len(octets) - WINDOW + 1, np.uint64)
        words = blocks.random_words(256, 5), blocks.random_words(5, 6)
        for at in range(0, len(least), HASHED_TOGETHER):
            least[at:at + HASHED_TOGETHER] = _minimisers(octets[at:at + HASHED_TOGETHER + WINDOW - 1], *words)
        start = np.sort(np.r_[np.flatnonzero(least[1:] != least[:-1]) + 1, begin])
        start = start[np.r_[True, start[1:] != start[:-1]]]
        doc = np.searchsorted(end, start, side="right")
        beyond = (end - WINDOW + 1)[doc]  # the text's last window and one more
        inside = (begin[doc] <= start) & (start < beyond)  # not at what stands between texts
        start, stop = start[inside], np.minimum(np.r_[start[1:], len(least)], beyond)[inside]
        parts = -(-(stop - start) // LONGEST)
        if (parts > 1).any():
            again = np.repeat(np.arange(len(start)), parts)
            nth = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = start[again] + nth * LONGEST
            stop = np.minimum(stop[again], start + LONGEST)
        doc = np.searchsorted(end, start, side="right")
        self.route, self.count = blocks.mixed(least[start]), stop - start  # least hashes are small: mixed, they spread over the buckets
        self.doc = keep[doc]
        self.start = start - begin[doc] + chunk.starts[self.doc]

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ascending distinct routes, key of each run, which keys several documents have)."""
        order = np.argsort(self.route)
        ranked, key_of = self.route[order], np.empty(len(order), np.int64)
        if not len(order):
            return self.route, key_of, np.zeros(0, bool)
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        key_of[order] = np.cumsum(new) - 1
        starts, doc = np.flatnonzero(new), self.doc[order]
        several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        return ranked[starts], key_of, several

    def large(self, key_of: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, octets) of the keys whose distinct strings may have more than STRING_OCTETS."""
        size = self.count + WINDOW - 1
        octets = np.bincount(key_of, weights=size, minlength=n_keys).astype(np.int64)
        runs = np.flatnonzero(octets[key_of] > STRING_OCTETS)
        distinct: dict[int, set[bytes]] = {}
        for k, a, n in zip(key_of[runs].tolist(), self.start[runs].tolist(), size[runs].tolist()):
            distinct.setdefault(k, set()).add(self.data[a:a + n])
        keys = np.array(sorted(distinct), np.int64)
        return keys, np.array([sum(map(len, distinct[k])) for k in keys.tolist()], np.int64)


def _emit_texts(bits: int):
    def run(batches: Iterator) -> Iterator:
        for chunk in blocks.rows_of(batches):
            digest, order = chunk.digests()
            blobs = [
                (b, TEXTS, digest[order[p]].tobytes(), np.stack([chunk.ids[order[p]], order[p]]).tobytes())
                for b, p in blocks.slices(digest[order, 0], bits)
            ]
            yield blocks.blob_batch(blobs, chunk.slot, chunk.chunk)

    return run


def _judge_texts(keys: list[bytes], extra: list[bytes]) -> list[bytes]:
    """Which texts (by place in their chunk) have an equal one with a smaller id?"""
    both = [np.frombuffer(e, "<i8").reshape(2, -1) for e in extra]
    repeated = blocks.judge_digests(keys, [ids.tobytes() for ids, _ in both])
    return [place[r].astype("<u4").tobytes() for (_, place), r in zip(both, repeated)]


def _copies(chunk: Chunk) -> np.ndarray:
    """For each document of a chunk: did :func:`_judge_texts` find an equal text before it?"""
    out, answers = np.zeros(len(chunk.ends), bool), chunk.answers("copies", TEXTS)
    if answers:
        out[answers[1].view("<u4")] = True
    return out


def _emit_grams(bits: int):
    def run(batches: Iterator) -> Iterator:
        for chunk in blocks.rows_of(batches):
            runs = Runs(chunk, _copies(chunk))
            keys, key_of, several = runs.keys()
            large, octets = runs.large(key_of, len(keys))
            # the last bit says whether several documents of the chunk have the key
            short = (keys >> np.uint64(32 - bits)).astype("<u4") & np.uint32(0xFFFFFFFE) | several
            packed, out = short.astype("<u4").tobytes(), []
            for b, p in blocks.slices(keys, bits):
                out.append((b, GRAMS, packed[4 * p.start:4 * p.stop], p))
            begin = np.searchsorted(large, [p.start for *_, p in out])
            stop = np.searchsorted(large, [p.stop for *_, p in out])
            extra = [b""] * len(out)
            for i in np.flatnonzero(stop > begin).tolist():
                mine = slice(begin[i], stop[i])
                extra[i] = np.stack([large[mine] - out[i][3].start, octets[mine]]).astype("<i8").tobytes()
            yield blocks.blob_batch([(*blob[:3], e) for blob, e in zip(out, extra)], chunk.slot, chunk.chunk)

    return run


def _judge_grams(octets: int):
    """Of each key: do several documents have it? Where a chunk's blob has keys with more than ``octets``
    of strings in all chunks, a second bit for each key follows: is it hot?"""

    def judge(keys: list[bytes], extra: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, keys), np.int64, len(keys)) // 4
        begin = np.cumsum(sizes) - sizes
        short = np.frombuffer(b"".join(keys), dtype="<u4")
        held = np.full(len(short), STRING_OCTETS)
        for i, e in enumerate(extra):
            if e:
                large, size = np.frombuffer(e, "<i8").reshape(2, -1)
                held[begin[i] + large] = size
        order = np.argsort(short >> 1)
        ranked = short[order]
        starts = np.flatnonzero(np.r_[True, ranked[1:] >> 1 != ranked[:-1] >> 1])
        count = np.diff(np.r_[starts, len(short)])
        hit = (count > 1) | np.logical_or.reduceat(ranked & 1 == 1, starts)
        hot = hit & (np.add.reduceat(held[order], starts) > octets)
        flags = np.empty(len(short), bool)
        flags[order] = np.repeat(hit, count)
        bits, borders = blocks.packed(flags, sizes)
        bits = bits.tobytes()
        out = [bits[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
        out = [b if any(b) else b"" for b in out]
        if hot.any():
            again = np.zeros(len(short), bool)
            again[order] = np.repeat(hot, count)
            for i in np.flatnonzero(np.logical_or.reduceat(again, begin)).tolist():
                part = slice(begin[i], begin[i] + sizes[i])
                out[i] = np.packbits(np.r_[flags[part], again[part]]).tobytes()
        return out

    return judge


def _window_hashes(octets: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of whole windows, by where they start."""
    word = blocks.random_words(256, 7)
    factor = blocks.random_words(1, 8)[0]
    h = np.zeros(len(start), np.uint64)
    for i in range(WINDOW):
        h = h * factor + word[octets[start + i]]
    return blocks.mixed(h)


class Strings:
    """The travelling strings of a chunk: each distinct one once, with its least id."""

    def __init__(self, chunk: Chunk, bits: int):
        self.copy = _copies(chunk)
        runs = Runs(chunk, self.copy)
        keys, key_of, _ = runs.keys()
        answers = chunk.answers("first", GRAMS)
        hit = blocks.read_bits(keys, answers, bits)
        hot = blocks.read_bits(keys, answers, bits, nth=1)
        goes = hit[key_of]
        self.start, self.count, self.route = runs.start[goes], runs.count[goes], runs.route[goes]
        self.ids = chunk.ids[runs.doc[goes]]
        if hot.any():
            self._break(chunk, hot[key_of[goes]])
        number: dict[bytes, int] = {}
        data = chunk.data
        stops = self.start + self.count + WINDOW - 1
        self.string = np.array(
            [number.setdefault(data[a:b], len(number)) for a, b in zip(self.start.tolist(), stops.tolist())], np.int64
        )
        self.distinct = list(number)
        self.least = np.full(len(number), blocks.LAST)
        np.minimum.at(self.least, self.string, self.ids)
        self.routes = np.zeros(len(number), np.uint64)
        self.routes[self.string] = self.route

    def _break(self, chunk: Chunk, hot: np.ndarray) -> None:
        """Runs of hot minimisers become runs of one window each, routed by all of it."""
        parts = np.where(hot, self.count, 1)
        again = np.repeat(np.arange(len(parts)), parts)
        nth = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.start, self.count = self.start[again] + nth, np.where(hot, 1, self.count)[again]
        self.route, self.ids = self.route[again], self.ids[again]
        single = hot[again]
        self.route[single] = _window_hashes(chunk.octets, self.start[single])


STRING = "route long, slot int, chunk long, nth int, least long, string binary"
REPLY = "slot int, chunk long, nths binary, sizes binary, bits binary"
ROWS = "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<start: long, stop: long>>"


def _emit_strings(bits: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for chunk in blocks.rows_of(batches):
            s = Strings(chunk, bits)
            n = len(s.distinct)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(s.routes.view(np.int64)), pa.array(np.full(n, chunk.slot, np.int32)),
                    pa.array(np.full(n, chunk.chunk, np.int64)), pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(s.least), pa.array(s.distinct, pa.binary()),
                ],
                ["route", "slot", "chunk", "nth", "least", "string"],
            )

    return run


def _sort_shards(octets: int, limit: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def answered(slot, chunk, nth, least, number: dict[bytes, int], string) -> list[np.ndarray]:
            """Of each string with an earlier window: chunk, slot, number, windows, octets of its bits; then all of these."""
            ids = np.full(len(number), blocks.LAST)
            np.minimum.at(ids, string, least)
            found, begin = least_of_windows(list(number), ids, limit=limit)
            hit = np.flatnonzero(np.minimum.reduceat(found, begin[:-1])[string] < least)  # every string has a window
            size = np.diff(begin)[string[hit]]
            flags = found[blocks.ranges(begin[string[hit]], size)] < np.repeat(least[hit], size)
            bits, borders = blocks.packed(flags, size)
            return [chunk[hit], slot[hit], nth[hit], size, np.diff(borders), bits]

        def replies(answers: list[list[np.ndarray]]):
            """One row for each chunk."""
            chunk, slot, nth, size, octets, bits = (np.concatenate(a) for a in zip(*answers))
            order = np.argsort(chunk, kind="stable")
            chunk, slot = chunk[order], slot[order]
            bits = bits[blocks.ranges((np.cumsum(octets) - octets)[order], octets[order])]
            begin = np.flatnonzero(np.r_[len(chunk) > 0, chunk[1:] != chunk[:-1]])
            border = [*begin.tolist(), len(chunk)]
            place = np.r_[0, np.cumsum(octets[order])][border].tolist()
            nth, size, bits = nth[order].astype("<i4").tobytes(), size[order].astype("<i4").tobytes(), bits.tobytes()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(slot[begin], pa.int32()), pa.array(chunk[begin], pa.int64()),
                    pa.array([nth[4 * a:4 * b] for a, b in zip(border, border[1:])], pa.binary()),
                    pa.array([size[4 * a:4 * b] for a, b in zip(border, border[1:])], pa.binary()),
                    pa.array([bits[a:b] for a, b in zip(place, place[1:])], pa.binary()),
                ],
                ["slot", "chunk", "nths", "sizes", "bits"],
            )

        answers: list[list[np.ndarray]] = []
        number: dict[bytes, int] = {}
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        held, last = 0, None

        def flush():
            nonlocal held
            slot, chunk, nth, least, string = (np.concatenate(c) for c in columns)
            answers.append(answered(slot, chunk, nth, least, number, string))
            number.clear()
            for c in columns:
                c.clear()
            held = 0

        for batch in batches:
            route = batch.column(0).to_numpy()
            others = [batch.column(i).to_numpy() for i in range(1, 5)]
            strings = batch.column(5).to_pylist()
            # shards end where a route ends; the first such place after every eighth of a shard will do
            border = np.flatnonzero(np.r_[len(route) > 0 and last is not None and route[0] != last, route[1:] != route[:-1]])
            size = np.fromiter(map(len, strings), np.int64, len(strings))
            eighth = (np.cumsum(size) - size)[border] // max(1, octets // 8)
            border = border[np.r_[True, eighth[1:] != eighth[:-1]]] if len(border) else border
            begin = 0
            for stop in [*border.tolist(), len(route)]:
                if stop > begin:
                    before = len(number)
                    place = np.array([number.setdefault(s, len(number)) for s in strings[begin:stop]], np.int64)
                    new = np.unique(place, return_index=True)[1]
                    held += int(size[begin:stop][new[place[new] >= before]].sum())
                    for c, values in zip(columns, [*(o[begin:stop] for o in others), place]):
                        c.append(values)
                    begin = stop
                if stop < len(route) and held >= octets:
                    flush()
            if len(route):
                last = route[-1]
            if sum(len(a[0]) for a in answers) >= ANSWERED_TOGETHER:
                yield replies(answers)
                answers.clear()
        if columns[0]:
            flush()
        if answers:
            yield replies(answers)

    return run


def _windows(found, s: Strings, first: np.ndarray) -> np.ndarray:
    """Where the windows start that answers call earlier, in the runs ``first`` of their strings."""
    nth, size = (blocks.octets_of(found.field(name))[0].view("<i4").astype(np.int64) for name in ("nths", "sizes"))
    octets = blocks.octets_of(found.field("bits"))[0]
    place = 8 * (np.cumsum(-(-size // 8)) - (-(-size // 8)))
    string = s.string[first]
    ranked, count = first[np.argsort(string, kind="stable")], np.bincount(string, minlength=len(s.distinct))
    runs = ranked[blocks.ranges((np.cumsum(count) - count)[nth], count[nth])]
    size, place = np.repeat(size, count[nth]), np.repeat(place, count[nth])
    return blocks.ranges(s.start[runs], size)[blocks.bit_at(octets, blocks.ranges(place, size))]


def _remove(bits: int, as_text: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for chunk in blocks.rows_of(batches):
            s = Strings(chunk, bits)
            gone = np.zeros(len(chunk.octets) + 1, bool)  # windows, by where they start
            later = s.ids > s.least[s.string]  # the chunk itself has the string earlier
            gone[blocks.ranges(s.start[later], s.count[later])] = True
            found = chunk.given("second")
            if found:
                gone[_windows(found, s, np.flatnonzero(~later))] = True
            # what follows a text is in no window, so that each span lies in one
            edge = np.flatnonzero(np.r_[gone[0], gone[1:] != gone[:-1]])
            begin, end = edge[::2], edge[1::2] + WINDOW - 1
            copy = s.copy & (chunk.ends - chunk.starts >= WINDOW)
            begin, end = np.sort(np.r_[begin, chunk.starts[copy]]), np.sort(np.r_[end, chunk.ends[copy]])
            apart = np.r_[True, begin[1:] > end[:-1], True]
            begin, end = begin[apart[:len(begin)]], end[apart[1:len(end) + 1]]
            doc, size = np.searchsorted(chunk.ends, begin, side="right"), chunk.ends - chunk.starts
            lost = np.bincount(doc, weights=end - begin, minlength=len(size)).astype(np.int64)
            stays = np.zeros(len(chunk.octets) + 1, np.int8)
            stays[0] = 1
            stays[begin] -= 1
            stays[end] += 1
            stays = np.cumsum(stays[:-1], dtype=np.int8).view(bool)
            stays[chunk.ends] = False
            kept = chunk.octets[stays].tobytes()
            border = np.r_[0, np.cumsum(size - lost)]
            if as_text:
                texts = pa.array([kept[a:b].decode("utf-8", "ignore") for a, b in zip(border[:-1].tolist(), border[1:].tolist())], pa.string())
            else:
                texts = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(border.astype(np.int32)), pa.py_buffer(kept)])
            spans = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(doc, np.arange(len(size) + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(at - chunk.starts[doc]) for at in (begin, end)], ["start", "stop"]),
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk.row["ids"], pa.int64()), pa.array(size), pa.array(lost), texts, spans, chunk.rest()],
                ["doc_id", "n_bytes", "n_removed", "kept", "spans", "rest"],
            )

    return run


def travelling(
    docs: DataFrame, bits: int, carry: list[str] | None = None, shard_octets: int = SHARD_OCTETS
) -> tuple[DataFrame, DataFrame]:
    """(chunks with the answers to their minimisers, STRING rows); the distinct strings of one route have
    at most ``shard_octets`` octets, or are one window."""
    table = blocks.chunk_table(docs, carry)
    texts = table.mapInArrow(_emit_texts(max(1, bits - 3)), blocks.BLOB)
    copies = written(blocks.exchange(texts, {TEXTS: _judge_texts}), "copies").withColumnRenamed("answers", "copies")
    met = table.join(copies, "slot", "left")
    first = blocks.exchange(met.mapInArrow(_emit_grams(bits), blocks.BLOB), {GRAMS: _judge_grams(shard_octets)})
    met = met.join(written(first, "grams").withColumnRenamed("answers", "first"), "slot", "left")
    return met, met.mapInArrow(_emit_strings(bits), STRING)


def remove_repeats(
    docs: DataFrame,
    carry: list[str] | None = None,
    as_text: bool = False,
    shard_octets: int = SHARD_OCTETS,
    queue_octets: int = QUEUE_OCTETS,
) -> DataFrame:
    """docs (doc_id, text) -> one row each: doc_id, n_bytes, n_removed, kept (octets), spans
    (maximal removed runs, in octets).

    Columns named in ``carry`` come back as the struct ``rest``. With ``as_text``, kept is a string,
    without the rests of characters that a removal cut through. A null text is empty; a null id comes after all others; rows of one id do not remove from
    each other; texts shorter than a window stay; other columns are ignored; no rows give no
    rows."""
    bits = blocks.bucket_bits(docs.sparkSession)
    met, strings = travelling(docs, bits, carry, shard_octets)
    replies = strings.repartition("route").sortWithinPartitions("route").mapInArrow(
        _sort_shards(shard_octets, queue_octets), REPLY
    )
    second = written(
        replies.groupBy("slot").agg(F.collect_list(F.struct("chunk", "nths", "sizes", "bits")).alias("second")), "suffixes"
    )
    rows = ROWS.replace("kept binary", "kept string") if as_text else ROWS
    return met.join(second, "slot", "left").mapInArrow(_remove(bits, as_text), blocks.with_rest(rows, docs, carry))


def op5_suffix_array(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
