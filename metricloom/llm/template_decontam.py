"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, the units after them, and names (capitals that no sentence start explains) are replaced
by typed placeholders, everything else is lower-cased; a run of names, or of digits with decimal and thousands marks, is one
placeholder. Windows of a document's template are looked up in a hash table of the benchmark's windows. Where they hit,
the two texts are laid side by side: runs of equal tokens on neighbouring shifts, in the order of both texts, add up, so
a word more or less breaks a run and not the match. The slots must be filled consistently: one value of the benchmark
item stands for one value of the document. So verbatim copies are caught and so are questions with other numbers or
names, while texts that merely share a frame are not.

Names are told by capitals, so each text has a second template in which they are words in lower case: it finds copies in
capitals or in lower case. What stands word for word counts whatever templates say: a run of VERBATIM tokens of an item,
or all of a shorter one.

The table of benchmark windows goes to every worker in parts of bounded size, one at a time; a larger benchmark takes
several passes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat_bytes, mix64, quoted, small_batches, span_hashes, texts_of, written

WINDOW = 5
#: Words of a window that must not be placeholders.
LEAST_WORDS = 3
#: Share of an item's template that a document must have on one alignment.
COVERED = 0.6
#: Tokens of a run that counts, and how far the shifts of one alignment may lie from that of its window.
LEAST_RUN = 4
NEAR_SHIFTS = 8
#: Tokens of an item that count word for word, whatever share of it they are; and of a window that finds them.
VERBATIM = 20
PLAIN_WINDOW = 8
#: Pairs of a text's window and an item's that are held at once.
PAIRS = 1 << 18
#: Bytes of benchmark text that one pass takes.
PASS_BYTES = 16 << 20

#: Units that may follow a number.
UNITS = (
    "mm cm m km in ft mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "mg g kg t oz lb lbs gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds ml l litre litres liter liters gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "usd eur gbp cent cents dollar dollars euro euros percent degree degrees watt watts volt volts hz khz mhz ghz kb mb gb tb byte bytes"
).split()

_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0xA1B2C3D4E5F60719, 0x1F2E3D4C5B6A7988, 0x7766554433221101))
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_MARKS = [ord(c) for c in ".,"]
_JOINTS = [ord(c) for c in " -'"]
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:;\n"]] = True


def _lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in lower case."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        capital = np.concatenate(([False], (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)))
        low[capital] += 32
    return low


@dataclass
class Templates:
    """Templates of a batch of texts: of each token its hash or placeholder, the hash of what stands there, text, and place in the data."""

    data: np.ndarray
    token: np.ndarray
    own: np.ndarray
    slot: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray  # first token of each text

    @classmethod
    def of(cls, texts: list[str]) -> Templates:
        return cls.views(texts)[0]

    @classmethod
    def views(cls, texts: list[str]) -> tuple[Templates, Templates, Templates]:
        """The templates, those with names as words, and the plain tokens in lower case."""
        data, starts = flat_bytes(texts)
        word = _KIND[data] > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
        a, b = edge[::2], edge[1::2]
        low = _lowered(data)
        own = span_hashes(low, a, b)
        doc = np.searchsorted(starts, a, side="right") - 1
        if not len(a):
            return (cls(data, own, own, np.zeros(0, bool), doc, np.zeros(len(texts) + 1, np.int64)),) * 3
        first = data[a]
        digits = (first >= 48) & (first <= 57)
        sentence = np.cumsum(_END[data], dtype=np.int32)[a]
        # a mark between digits, without a space, ends no sentence and belongs to the number
        gap = (doc[1:] == doc[:-1]) & (a[1:] == b[:-1] + 1)
        glued = gap & digits[1:] & digits[:-1] & np.isin(data[b[:-1]], _MARKS)
        begins = np.concatenate(([True], ((sentence[1:] != sentence[:-1]) & ~glued) | (doc[1:] != doc[:-1])))
        name = (data[a] != low[a]) | ((first == 0xC3) & (data[np.minimum(a + 1, len(data) - 1)] != low[np.minimum(a + 1, len(data) - 1)]))
        name &= ~begins
        joined = gap & np.isin(data[b[:-1]], _JOINTS)
        numbers = glued | (joined & digits[1:] & digits[:-1] & ~begins[1:])
        cut = lambda d: np.searchsorted(d, np.arange(len(texts) + 1))

        def view(name: np.ndarray) -> Templates:
            goes_on = np.concatenate(([False], numbers | (joined & name[1:] & name[:-1])))
            lead = np.flatnonzero(~goes_on)
            value = own.copy()
            for k in np.flatnonzero(goes_on).tolist():
                value[k] = mix64(value[k - 1 : k] * np.uint64(0xD6E8FEB86659FD93) + own[k : k + 1])[0]
            value = value[np.append(lead[1:], len(a)) - 1]  # of a run, the hash of all its tokens
            first, number, named = own[lead], digits[lead], name[lead]
            unit = np.concatenate(([False], number[:-1] & ~begins[lead][1:])) & np.isin(first, _unit_hashes()) & ~number
            token = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(named, _NAME, first)))
            return cls(data, token, value, number | unit | named, doc[lead], cut(doc[lead]))

        none = np.zeros(len(a), bool)
        return view(name), view(none), cls(data, own, own, none, doc, cut(doc))

    def plain_windows(self, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each size the hash and first token of each window inside one text."""
        h = self.token
        for size in range(1, max(sizes, default=0) + 1):
            n = len(self.token) - size + 1
            if n <= 0:
                return
            h = h[:n] * np.uint64(0xD6E8FEB86659FD93) + self.token[size - 1 :] if size > 1 else h
            if size in sizes:
                at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
                yield size, mix64(h[at] + np.uint64(size)), at

    def windows(self, size: int = WINDOW, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first token of each window with enough words inside one text."""
        n = len(self.token) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.token[:n].copy()
        for k in range(1, size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.token[k : k + n]
        words = np.concatenate(([0], np.cumsum(~self.slot)))
        good = (self.doc[:n] == self.doc[size - 1 :]) & (words[size:] - words[:n] >= least)
        at = np.flatnonzero(good)
        return mix64(h[at]), at


_UNIT_HASHES: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _UNIT_HASHES:
        data, starts = flat_bytes(UNITS)
        _UNIT_HASHES.append(np.sort(span_hashes(data, starts[:-1], starts[1:] - 1)))
    return _UNIT_HASHES[0]


def _alignment(mine: np.ndarray, theirs: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal tokens in ``mine`` and ``theirs``: the runs on shifts near the given one that follow each other in
    both and together have most tokens."""
    shifts = np.arange(shift - NEAR_SHIFTS, shift + NEAR_SHIFTS + 1)
    at = shifts[:, None] + np.arange(len(mine))
    same = (at >= 0) & (at < len(theirs))
    same &= theirs[np.clip(at, 0, len(theirs) - 1)] == mine
    edge = np.diff(np.pad(same, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, first), (_, last) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    long = last - first >= LEAST_RUN
    runs = sorted(zip(last[long].tolist(), first[long].tolist(), shifts[row[long]].tolist()))
    most: list[tuple[int, int, int]] = []  # of each run: tokens of the best chain that it ends, where it starts in that, the run before
    for k, (end, start, s) in enumerate(runs):
        chain = (end - start, start, -1)
        for j, (before, _, s0) in enumerate(runs[:k]):
            begin = max(start, before, before + s0 - s)
            if end - begin > 0 and most[j][0] + end - begin > chain[0]:
                chain = (most[j][0] + end - begin, begin, j)
        most.append(chain)
    here, there = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    k = max(range(len(most)), key=lambda x: most[x][0], default=-1)
    while k >= 0:
        here.append(np.arange(most[k][1], runs[k][0]))
        there.append(here[-1] + runs[k][2])
        k = most[k][2]
    return np.concatenate(here), np.concatenate(there)


@dataclass
class Lookup:
    """Windows of benchmark items: sorted hashes, and the item and token that each is from."""

    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, t: Templates, hashes: np.ndarray, at: np.ndarray) -> Lookup:
        order = np.argsort(hashes, kind="stable")
        doc = t.doc[at[order]]
        return cls(hashes[order], doc, at[order] - t.bounds[doc])

    def __post_init__(self):
        self.known = np.zeros(1 << 20, bool)
        self.known[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Token, item and token of the item of each window that both have, in pieces of bounded size."""
        maybe = np.flatnonzero(self.known[(h >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hashes, h[maybe]), np.searchsorted(self.hashes, h[maybe], side="right")
        hit = hi > lo
        p, lo, n = at[maybe][hit], lo[hit], (hi - lo)[hit]
        ends = np.cumsum(n)
        for a in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
            k = np.arange(a, min(a + PAIRS, int(ends[-1])))
            which = np.searchsorted(ends, k, side="right")
            theirs = lo[which] + k - (ends - n)[which]
            yield p[which], self.item[theirs], self.at[theirs]


@dataclass
class Index:
    """Benchmark items as three views, with lookups of their windows; those of plain tokens by window size."""

    items: list[int]
    views: tuple[Templates, Templates, Templates]
    lookups: list[Lookup]
    plain: dict[int, Lookup]
    size: int = WINDOW

    @classmethod
    def of(cls, items: list[tuple[int, str]], size: int = WINDOW, least: int = LEAST_WORDS) -> Index:
        """Of items with the same text the smallest id stands for all."""
        first: dict[str, int] = {}
        for i, t in sorted(x for x in items if x[0] is not None and x[1]):
            first.setdefault(t, i)
        views = Templates.views(list(first))
        lookups = [Lookup.of(t, *t.windows(size, least)) for t in views[:2]]
        t, plain = views[2], {}
        length = np.diff(t.bounds)
        for k, h, at in t.plain_windows(list(range(1, PLAIN_WINDOW + 1))):
            # a short item is a window of its size; of others every so-manieth window, so that a run of VERBATIM has one
            mine = (length[t.doc[at]] == k) if k < PLAIN_WINDOW else (at - t.bounds[t.doc[at]]) % PLAIN_WINDOW == 0
            if mine.any():
                plain[k] = Lookup.of(t, h[mine], at[mine])
        return cls(list(first.values()), views, lookups, plain, size)

    def found(self, texts: list[str], covered: float = COVERED) -> list[list[tuple[int, float, int, int]]]:
        """Of each text the items that it has: item, share of the item's template (or tokens, of what is found word for word
        only), its slots, and those with another value."""
        out: list[list[tuple[int, float, int, int]]] = [[] for _ in texts]
        if not self.items:
            return out
        views = Templates.views(texts)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for items, lookup, t in zip(self.views, self.lookups, views):
            best |= self._by_template(items, lookup, t, covered, best)
        best |= self._word_for_word(views[2], best)
        for (d, i), (share, slots, changed) in sorted(best.items()):
            out[d].append((self.items[i], share, slots, changed))
        return out

    def _by_template(self, items: Templates, lookup: Lookup, t: Templates, covered: float, before: dict) -> dict:
        lined: dict[tuple[int, int], set[int]] = defaultdict(set)
        for p, i, at in lookup.hits(*t.windows(self.size)):
            d = t.doc[p]
            key, shift = d * len(self.items) + i, p - t.bounds[d] - at
            order = np.lexsort((shift, key))
            key, shift = key[order], shift[order]
            first = np.concatenate(([True], (key[1:] != key[:-1]) | (shift[1:] != shift[:-1])))
            for k, s in zip(key[first].tolist(), shift[first].tolist()):
                if (pair := divmod(k, len(self.items))) not in before:
                    lined[pair].add(s)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for (d, i), shifts in lined.items():
            mine, own, slot = (x[items.bounds[i] : items.bounds[i + 1]] for x in (items.token, items.own, items.slot))
            lo, hi = int(t.bounds[d]), int(t.bounds[d + 1])
            for shift in sorted(shifts):
                here, there = _alignment(mine, t.token[lo:hi], shift)
                share = len(here) / len(mine)
                if share < covered or share <= best.get((d, i), (0.0,))[0]:
                    continue
                filled = slot[here]
                theirs, ours = own[here[filled]], t.own[lo + there[filled]]
                if len({(x, y) for x, y in zip(theirs.tolist(), ours.tolist())}) == len(set(theirs.tolist())):  # each value has one counterpart
                    best[d, i] = (share, len(theirs), int((theirs != ours).sum()))
                if share == 1.0:
                    break
        return best

    def _word_for_word(self, t: Templates, before: dict) -> dict:
        items, best = self.views[2], {}
        for k, h, p in t.plain_windows(list(self.plain)):
            for p, i, at in (x for some in self.plain[k].hits(h, p) for x in zip(*(c.tolist() for c in some))):
                d = int(t.doc[p])
                if (d, i) in before:
                    continue
                lo, hi, a, b = int(items.bounds[i]), int(items.bounds[i + 1]), int(t.bounds[d]), int(t.bounds[d + 1])
                back, on = min(at, p - a), min(hi - lo - at, b - p)
                other = np.flatnonzero(items.own[lo + at - back : lo + at + on] != t.own[p - back : p + on]) - back
                run = int(other[other >= 0].min(initial=on)) - int(other[other < 0].max(initial=-back - 1)) - 1
                if run >= min(VERBATIM, hi - lo) and run / (hi - lo) > best.get((d, i), (0.0,))[0]:
                    best[d, i] = (run / (hi - lo), 0, 0)
        return best


def indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", pass_bytes: int | None = None) -> Iterator:
    """Broadcast indexes of the benchmark, each of at most about ``pass_bytes`` of text, one after the other. Each is taken back
    when the next is asked for: no more than one is held by the workers."""
    pass_bytes = pass_bytes or PASS_BYTES
    rows = benchmark.select(F.col(item_id).cast("bigint").alias("i"), F.col(text).cast("string").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // pass_bytes))
    for k in range(parts):
        shared = benchmark.sparkSession.sparkContext.broadcast(Index.of([tuple(r) for r in rows.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == k).collect()]))
        yield shared, k == parts - 1
        if k < parts - 1:
            shared.destroy()


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", covered: float = COVERED) -> DataFrame:
    """doc_id, item_id, covered, slots, changed_slots of every item that a document has.

    Null and empty texts have none; items without id or text are never found, an item shorter than a window where its tokens
    stand in a row, also if it is a single one; of equal items the smallest id is given. Repeated rows and null ids: rows
    each. Very long texts are judged whole, in a batch of their own, with memory in proportion. Empty tables: no row. Other
    columns, whatever their names, are not read. A benchmark of more than PASS_BYTES takes several passes over the
    documents, whose pairs are written to the shared folder.
    """
    small_batches(docs.sparkSession)
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for shared, last in indexes(benchmark, item_id, item_text):

        def find(batches: Iterator[pa.RecordBatch], index=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, ids = texts_of(batch), batch.column("doc_id").to_pylist()
                got = [(i, *f) for i, found in zip(ids, index.value.found(texts, covered)) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "covered", "slots", "changed_slots"])

        pairs = rows.mapInArrow(find, "doc_id bigint, item_id bigint, covered double, slots bigint, changed_slots bigint")
        pairs = pairs if last else written(pairs, "leaks")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _leak_column(index, text: str, covered: float) -> Column:
    def any_found(texts):
        return pd.Series([bool(f) for f in index.value.found([t or "" for t in texts], covered)], dtype=bool)

    any_found.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(any_found, "boolean")(F.col(quoted(text)).cast("string"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", covered: float = COVERED) -> DataFrame:
    """The documents that have no item of the benchmark, with all their columns.

    Null and empty texts stay; repeated rows are judged alike, very long texts whole; an empty benchmark lets all stay. A
    benchmark of more than PASS_BYTES takes several passes; what each leaves is written to the shared folder.
    """
    small_batches(docs.sparkSession)
    for shared, last in indexes(benchmark):
        docs = docs.where(~_leak_column(shared, text, covered))
        docs = docs if last else written(docs, "clean")
    return docs
