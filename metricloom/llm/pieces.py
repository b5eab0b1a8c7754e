"""Exact ids of a byte-level BPE tokenizer through a cache of space-led pieces.

The pre-tokenizer's pattern never lets a pre-token run on past a non-space character into a space, so a text whose
white space is single spaces and single newlines between other characters falls apart at each of them: every space
leads the piece after it, every newline is a token of its own. Texts with any other white space at a piece's edge, or
with the string of an added token, go whole to the library. A piece not yet known is cut into pre-tokens (by the library,
but for plain words) and each is given to the library's model once.
"""

from __future__ import annotations

import json
import os
import string
import sys
from array import array
from collections.abc import Iterable
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Below this code point, str.isalpha tells the letters of any Unicode version.
PLAIN = "ɐ"
#: ASCII characters that are neither letters nor digits nor white space.
MARKS = string.punctuation
#: Runs of marks that a worker remembers.
MOST_MARKS = 20_000
#: Bytes of text that are cut up at once, or one text.
LOT = 8 << 20
#: Pieces that a resting worker keeps.
REST = 200_000


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it prints, else the next free from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _raw(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


def split(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Pieces of texts without nulls: for each its place among the distinct ones, these, and where each text's begin.

    A piece stands for a space and itself; one that begins with a newline stands for itself. Each text's first is given a
    newline that the text hasn't.
    """
    spaced = pc.replace_substring(pc.binary_join_element_wise("\n", column, ""), "\n", " \n")
    lists = pc.split_pattern(spaced, " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    inner = np.ones(len(coded), bool)
    inner[bounds[:-1] - bounds[0]] = False  # the empty string before the first space
    return coded.indices.to_numpy()[inner], coded.dictionary, bounds - bounds[0] - np.arange(len(bounds))


class PieceEncoder:
    """Ids (little-endian unsigned 32-bit) of whole texts, or their number. ``frequent`` has values of pieces, which are known
    from the start; ``cap`` bounds what the worker keeps besides."""

    def __init__(self, path: str, frequent: dict | None = None, cap: int = 600_000, lengths_only: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_piece = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model.get("type") == "BPE"
            and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding") and not model.get("dropout") and len(newline) == 1
        )
        self.lengths_only, self.cap = lengths_only, cap
        self.newline = 1 if lengths_only else np.array(newline, "<u4").tobytes()
        self.stand_ins = _byte_alphabet()
        self.space = self.stand_ins[0x20]
        self.tokenize, self.cut = self.tokenizer.model.tokenize, self.tokenizer.pre_tokenizer.pre_tokenize_str if self.by_piece else None
        self.marks: dict = {}
        self.frequent = dict(frequent or {}) if self.by_piece else {}
        self.cache = dict(self.frequent)

    def _whole(self, text: str):
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return len(ids) if self.lengths_only else np.array(ids, "<u4").tobytes()

    def _values(self, words: Iterable[list[str]]) -> list:
        """Ids or number of ids of words, each given as its pre-tokens."""
        tokenize = self.tokenize
        made = [tokenize(w[0]) if len(w) == 1 else [t for p in w for t in tokenize(p)] for w in words]
        sizes = list(map(len, made))
        if self.lengths_only:
            return sizes
        raw = _raw([t.id for m in made for t in m])
        ends = list(accumulate(4 * n for n in sizes))
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _learnt(self, missing: list[str]) -> dict:
        """Values of unknown pieces; None if white space stands at the piece's edge: its text must be encoded whole."""
        known, marks, new = self.cache, self.marks, {}
        plain, marked, other = [], [], []
        for p in missing:
            if p.isalpha():
                plain.append(p)
                continue
            body = p.rstrip(MARKS)
            if body.isalpha() or body[:1] == "\n" and body[1:].isalpha():  # a letter never joins the marks after it, and these are one pre-token
                marked.append((p, body, p[len(body) :]))
            else:
                core = p[1:] if p[:1] == "\n" else p
                if not core or core[0].isspace() or core[-1].isspace():
                    new[p] = None
                else:
                    other.append(p)
        words = [*plain, *{b for _, b, _ in marked if b not in known}.difference(plain)]
        exotic = [p for p in words if not p.isascii() and max(p) >= PLAIN]
        if exotic:
            words, other = [p for p in words if p.isascii() or max(p) < PLAIN], other + exotic
        led, space, stand_ins = {}, self.space, self.stand_ins
        for p in words:  # one pre-token each
            w = p[1:] if p[0] == "\n" else space + p
            led[p] = [w if p.isascii() else (p[1:] if p[0] == "\n" else " " + p).encode().decode("latin-1").translate(stand_ins)]
        for p in other:
            led[p] = [x for x, _ in self.cut(p[1:] if p[0] == "\n" else " " + p)]
        newline = self.newline
        new.update((p, newline + v if p[0] == "\n" else v) for p, v in zip(led, self._values(led.values())))
        if ends := list({e for _, _, e in marked if e not in marks}):
            marks.update(zip(ends, self._values([[e] for e in ends])))
            if len(marks) > MOST_MARKS:
                self.marks = {}
        for p, body, end in marked:
            if end:
                new[p] = (new[body] if body in new else known[body]) + marks[end]
        return new

    def lookup(self, distinct: list[str]) -> list:
        """Values of distinct pieces. Beyond the cap the cache goes back to the first pieces learnt, mostly the frequent ones."""
        new = self._learnt([p for p in distinct if p not in self.cache])
        if len(self.cache) + len(new) > self.cap:
            asked = {p: self.cache[p] for p in distinct if p in self.cache}
            self.rest()
            self.cache.update(asked)
        self.cache.update(new)
        return list(map(self.cache.__getitem__, distinct))

    def rest(self, keep: int = REST) -> None:
        """At a task's end: an idle worker holds little."""
        self.cache = dict(islice(self.cache.items(), max(min(keep, self.cap), len(self.frequent))))

    def encode(self, texts: list[str] | pa.Array) -> list:
        """Of each text the ids as bytes, or their number; null as empty."""
        column = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())), "")
        out, start, size = [], 0, 0
        for row, n in enumerate(pc.binary_length(column).to_pylist()):
            size += n
            if size >= LOT:
                out += self._encode(column[start : row + 1])
                start, size = row + 1, 0
        return out + self._encode(column[start:]) if start < len(column) else out

    def _encode(self, column: pa.Array) -> list:
        if not self.by_piece:
            return [self._whole(t) if t else (0 if self.lengths_only else b"") for t in column.to_pylist()]
        codes, distinct, bounds = split(column)
        values = self.lookup(distinct.to_pylist())
        bad = np.array([v is None for v in values], bool)
        # a None is white space at a piece's edge
        whole = np.logical_or.reduceat(bad[codes], bounds[:-1])
        for a in self.added:
            whole |= pc.match_substring(column, a).to_numpy(zero_copy_only=False)
        if self.lengths_only:
            counts = np.add.reduceat(np.array([v or 0 for v in values], np.int64)[codes], bounds[:-1]) - 1
            out = counts.tolist()
        else:
            joined = pa.array([v or b"" for v in values], pa.binary()).take(pa.array(codes))
            at = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1)[bounds].tolist()
            raw = memoryview(joined.buffers()[2] or b"")
            out = [bytes(raw[a + 4 : b]) for a, b in zip(at, at[1:])]
        for d in np.flatnonzero(whole).tolist():
            out[d] = self._whole(column[d].as_py())
        empty = pc.equal(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        for d in np.flatnonzero(empty).tolist():
            out[d] = 0 if self.lengths_only else b""
        return out


_ENCODERS: dict = {}


def encoder(path: str, frequent: dict | None = None, key: str = "", **options) -> PieceEncoder:
    """One encoder for each worker process and set of options; the cache lives on between tasks."""
    full = (path, key, *sorted(options.items()))
    if full not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[full] = PieceEncoder(path, frequent, **options)
    return _ENCODERS[full]
