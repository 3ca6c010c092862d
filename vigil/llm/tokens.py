"""Token ids of whole texts by the ``tokenizers`` library, with a cache of word pieces.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the ids of the
pieces, joined, are the ids of the text; pieces repeat a lot, texts do not. Texts with
unusual white space are encoded whole. Strings of special tokens inside a text are
ordinary text (``encode_special_tokens``), or with ``special_tokens`` those tokens; texts that
hold one are encoded whole then.

Styles (which cuts are safe):
    byte   byte-level BPE whose pattern keeps one leading space with a word
    word   word-end BPE that drops white space and lower-cases
    plain  no cuts: every text is encoded whole
"""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterator

import numpy as np

from vigil.llm.common import worker_state

#: Cache entries a worker keeps (about 200 bytes each); a full cache is emptied.
CACHE_ENTRIES = 900_000
#: ASCII punctuation; the apostrophe can begin a contraction, which is a pre-token of its own.
TRAILING = string.punctuation.replace("'", "")
#: Bytes of text whose pieces are numbered together, and words given to the tokenizer at once.
SLICE_BYTES = 6 << 20
WORDS_PER_CALL = 200
#: A blank in the alphabet of byte-level BPE.
BLANK = "\u0120"


class PieceEncoder(dict):
    """piece -> little-endian uint32 ids as bytes; ``ids(text)`` joins a text's pieces."""

    def __init__(self, path: str, style: str = "plain", entries: int = CACHE_ENTRIES, special_tokens: bool = False):
        from tokenizers import Tokenizer

        super().__init__()
        if style not in ("plain", "byte", "word"):
            raise ValueError(f"unknown style {style!r}")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special_tokens
        # texts that hold a token's own string are encoded whole
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile(b"|".join(map(re.escape, added)), re.IGNORECASE) if special_tokens and added else None
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.style, self.entries = style, entries
        self.direct = style == "byte" and self._keeps_words()
        # anything but single blanks and single newlines between words: encode the whole text
        self.unusual = re.compile(r"\s\s|^\s|\s$|[^\S \n]|\x00").search

    def _keeps_words(self) -> bool:
        """Whether a blank and letters always go to the model as they are, as one pre-token: byte-level BPE with
        its own pattern, no normaliser, and no added token that is taken inside ordinary text."""
        from tokenizers import models, pre_tokenizers

        cut, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        return (
            type(cut) is pre_tokenizers.ByteLevel and cut.use_regex and self.tokenizer.normalizer is None
            and type(model) is models.BPE and not model.dropout
            and all(t.special for t in self.tokenizer.get_added_tokens_decoder().values())
        )

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        stem = piece.rstrip(TRAILING)
        if stem != piece and stem and stem[-1].isalpha():  # letters, then a run of punctuation
            out = self[stem] + self[piece[len(stem):]]
        else:
            out = self.whole(piece)
        self[piece] = out
        return out

    def _words(self, pieces: list[str]) -> list[str | None]:
        """The letters that each piece begins with, if all before its trailing punctuation."""
        stems = [piece.rstrip(TRAILING) for piece in pieces]
        if self.style == "byte":
            return [stem if stem[:1] == " " and stem[1:].isalpha() else None for stem in stems]
        return [stem if stem.isalpha() else None for stem in stems]

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of ``pieces``. ASCII words not in the cache go straight to the model where it sees them as they are,
        other words to the tokenizer many in one call; a call whose pre-tokens are not its words one by one is left
        to the lookup of single pieces."""
        found = list(map(self.get, pieces))
        missing = [k for k, f in enumerate(found) if f is None]
        if len(self) + len(missing) > self.entries:
            self.clear()
        stems = self._words([pieces[k] for k in missing])
        words = list({w: None for w in stems if w is not None and w not in self})
        if self.direct:  # the byte-level alphabet writes the blank as BLANK and ASCII letters as themselves
            tokenize = self.tokenizer.model.tokenize
            for w in filter(str.isascii, words):
                self[w] = array("I", [t.id for t in tokenize(BLANK + w[1:])]).tobytes()
            words = [w for w in words if not w.isascii()]
        joint = "" if self.style == "byte" else " "
        for at in range(0, len(words), WORDS_PER_CALL):
            some = words[at:at + WORDS_PER_CALL]
            joined = self.tokenizer.encode(joint.join(some), add_special_tokens=False)
            owner = np.array(joined.word_ids, dtype=np.int64)
            stops = np.append(np.flatnonzero(np.diff(owner)) + 1, len(owner))
            if len(stops) != len(some):
                continue
            data = np.array(joined.ids, dtype="<u4").tobytes()
            ends = (4 * stops).tolist()
            self.update((w, data[a:b]) for w, a, b in zip(some, [0, *ends], ends))
        for k, stem in zip(missing, stems):
            piece = pieces[k]
            if stem is None or len(stem) == len(piece):
                found[k] = self[piece]
            else:
                found[k] = self[stem] + self[piece[len(stem):]]  # not kept: the word and the rest are
        return found

    def ids(self, text: str) -> bytes:
        import pyarrow as pa

        return next(self.many(pa.array([text], pa.string())))

    def many(self, texts) -> Iterator[bytes]:
        """Ids of every text of an Arrow string array; a null text is empty. Texts are taken
        in slices of about SLICE_BYTES (or one longer text), one slice in memory at a time."""
        import pyarrow.compute as pc

        if self.style == "plain":
            yield from (self.whole(t.as_py() or "") for t in texts)
            return
        filled = pc.fill_null(texts, "").cast("large_string")
        part = np.cumsum(pc.binary_length(filled).to_numpy(zero_copy_only=False)) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(filled)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield from self._slice(filled.slice(a, b - a))

    def _slice(self, texts) -> list[bytes]:
        """Cut a slice's texts before every blank and around every newline, number the distinct
        pieces, look only those up, and gather the ids by number."""
        import pyarrow as pa

        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
        base, size = int(bounds[0]), int(bounds[-1] - bounds[0])
        if not size:
            return [b""] * n
        data = np.frombuffer(texts.buffers()[2], np.uint8)[base:base + size]
        bounds = bounds - base
        newline = data == 10
        blank = (data == 32) | newline

        def owner(at: np.ndarray) -> np.ndarray:
            return np.searchsorted(bounds, at, side="right") - 1

        # unusual texts: two blanks in a row, one at an end, or by the pattern beyond ASCII text
        unusual = np.zeros(n, bool)
        twice = np.flatnonzero(blank[1:] & blank[:-1]) + 1
        of = owner(twice)
        unusual[of[bounds[of] != twice]] = True
        filled = np.flatnonzero(np.diff(bounds))
        unusual[filled] |= blank[bounds[filled]] | blank[bounds[filled + 1] - 1]
        beyond = np.zeros(n, bool)
        # lead bytes of all blanks beyond ASCII, and control characters
        lead = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)) | ((data < 32) & ~newline)
        beyond[owner(np.flatnonzero(lead))] = True
        for at in np.flatnonzero(beyond & ~unusual).tolist():
            unusual[at] = bool(self.unusual(texts[at].as_py()))

        if self.added is not None:
            held = [m.start() for m in self.added.finditer(memoryview(data))]
            unusual[owner(np.array(held, np.int64))] = True

        first = blank.copy()
        first[1:] |= newline[:-1]
        first[bounds[filled]] = True
        starts = np.flatnonzero(first)
        offsets = np.append(starts, size) + base
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), texts.buffers()[2])
        if unusual.any():
            usual = ~unusual[owner(starts)]
            pieces, starts = pieces.filter(pa.array(usual)), starts[usual]
        numbered = pieces.dictionary_encode()
        code = numbered.indices.to_numpy()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each
        if self.style == "word":
            distinct = [p.strip(" \n") for p in distinct]
        found = self.learn(distinct)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        taken = lengths[code]
        stops = np.concatenate([np.zeros(1, np.int64), np.cumsum(taken)])
        ids = flat[np.repeat((np.cumsum(lengths) - lengths)[code] - stops[:-1], taken) + np.arange(stops[-1])].tobytes()
        at = (4 * stops[np.searchsorted(starts, bounds)]).tolist()
        return [
            self.whole(texts[k].as_py()) if odd else ids[a:b]
            for k, (odd, a, b) in enumerate(zip(unusual.tolist(), at, at[1:]))
        ]


def encoder(path: str, style: str, special_tokens: bool = False) -> PieceEncoder:
    """The worker's encoder for a vocabulary file; kept between tasks."""
    kept = worker_state()
    key = path, style, special_tokens
    if key not in kept:
        kept[key] = PieceEncoder(path, style, special_tokens=special_tokens)
    return kept[key]
