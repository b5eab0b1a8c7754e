"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most ``radius`` bits agree on at least ``blocks - radius`` of ``blocks`` bit blocks, so
every linked pair meets in a bucket for some choice of that many blocks; no pair is lost, whatever the number of blocks.
More fingerprints get more blocks, so that a bucket of unrelated ones stays small. Inside the buckets the fingerprints
are stored vertically, one plane of 64-lane words for each bit. Shifting the planes by d lanes compares every row with
the d-th after it; the differing bits are added up by carry-save counters, and a word of lanes is abandoned once all its
lanes exceed the radius. Each bucket gives the edges of a spanning forest of its links only, and components of these
edges are found by alternating large-star and small-star steps on tables.

Copies share a fingerprint and are compared once. A bucket above ``bucket_rows`` fingerprints is dealt into parts, each
of which has the bucket's first fingerprint too; what that joins needs no comparison with each other, and only the rest is
compared with all parts (``_spanned``). Buckets, stars and groups of copies with a great share of all rows are joined
by broadcasting their few keys (``join_hot``), so none is a single task's.

A few bits of 64 find copies with few changes only. For a shingle similarity of 0.8 the same comparison runs on wide
fingerprints of 256 bits, in which every distinct shingle counts once: at that similarity 15 % of the bits differ, of
unrelated texts half. No choice of bit blocks is both exact and selective at so wide a radius, so the wide buckets are
equal bands of smallest shingle hashes, which unrelated texts do not share however many there are. What they find are
candidates: their components are clusters, and inside each cluster texts are linked by the exact Jaccard similarity of
their shingle sets (``alike_edges``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, flat_bytes, forget, fresh, join_hot, mix64, quoted, small_batches, written
from .xxh64 import xxh64

RADIUS = 4
#: Bit blocks of few fingerprints, and of most; unrelated fingerprints that a bucket may have on average.
BLOCKS = 6
MOST_BLOCKS = 12
BUCKET_MEAN = 16
SHINGLE = 4
SEED = 42
#: Fingerprints of one bucket that a single comparison takes at most.
BUCKET_ROWS = 4096
#: Rows of whole buckets that are compared at once, and words of lanes, over several shifts.
LOT = 1 << 16
SHIFTS_AT_ONCE = 1 << 13

#: Wide fingerprints: 64-bit lanes, words of a shingle, and the bits that candidates may differ in: Jaccard 0.8 gives 39 on average, 58 at most in 2,400 pairs.
LANES = 4
WIDE_SHINGLE = 5
WIDE_RADIUS = 60
#: Bands of smallest hashes, and hashes of each: a pair at Jaccard 0.8 shares no band in 1 of 2,800 cases, at 0.85 in 1 of 88,000.
BANDS = 20
BAND_HASHES = 5
#: Jaccard similarity of near copies, as a fraction.
ALIKE = (4, 5)
#: Texts of one cluster that are compared exactly by a task at most, in each of two parts, and bytes of text held for that.
ALIKE_ROWS = 512
ALIKE_BYTES = 16 << 20

#: Rows of (id, hashes) that are broadcast at most, some 32 MB; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[IS_SPACE] = 32


def _shingle_hashes(texts: list[str | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 with SEED of each word shingle of whole texts, A-Z in lower case, words a space apart, and where each text's
    begin (one entry more). Fewer words are one shingle."""
    data, bounds = flat_bytes([t or "" for t in texts])
    space = IS_SPACE[data]
    kept = ~space
    kept[1:] |= kept[:-1]  # of each run of white space the first
    place = np.cumsum(kept)
    data, bounds = _PLAIN[data[kept]], np.concatenate(([0], place[bounds[1:] - 1])) if len(texts) else bounds
    space = data == 32
    stops = np.flatnonzero(space)
    stops = stops[np.concatenate(([stops[0] > 0], np.diff(stops) > 1))] if len(stops) else stops  # a text that begins with white space
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(data) else stops
    first = np.searchsorted(starts, bounds)  # word of each text
    words = np.diff(first)
    n = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    at = np.concatenate(([0], np.cumsum(n)))
    word = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], n)
    last = np.minimum(word + shingle, np.repeat(first[1:], n)) - 1
    return xxh64(data, starts[word], stops[last], SEED), at


def shingle_set(text: str | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a whole text; no word: none."""
    return np.unique(_shingle_hashes([text], shingle)[0])


def _ones_in_each_bit(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of the 64-bit numbers from each start to the next have each bit; no stretch is empty. Bits are bytes of eight
    64-bit words, which are added up 255 numbers at a time."""
    cuts = np.union1d(starts, np.arange(0, len(h), 255))
    sums = np.empty((len(cuts), 64), np.uint8)
    for c in range(0, len(cuts), 256):
        lo, hi = cuts[c], cuts[c + 256] if c + 256 < len(cuts) else len(h)
        bits = np.unpackbits(np.ascontiguousarray(h[lo:hi]).view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        sums[c : c + 256] = np.add.reduceat(bits, cuts[c : c + 256] - lo, axis=0).view(np.uint8)
    return np.add.reduceat(sums, np.searchsorted(cuts, starts), axis=0, dtype=np.int64)


def _lane(h: np.ndarray, k: int) -> np.ndarray:
    return mix64(h + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)) if k else h


def _majority(total: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * total > n, axis=-1, bitorder="little").view("<u8").ravel()


def fingerprint_lanes(text: str | None, shingle: int = SHINGLE, lanes: int = 1, distinct: bool = False) -> np.ndarray:
    """SimHash of a whole text over word shingles in 64-bit lanes, repeats included unless ``distinct``; no word: zeros.
    The first lane's hashes are XXH64 with SEED, the others are scrambled from these."""
    h = shingle_set(text, shingle) if distinct else _shingle_hashes([text], shingle)[0]
    return _simhashes(h, np.array([0, len(h)]), lanes)[0]


def _simhashes(h: np.ndarray, bounds: np.ndarray, lanes: int) -> np.ndarray:
    """SimHash of each stretch of hashes between two bounds, in lanes; zeros of an empty one."""
    size = np.diff(bounds)
    some = np.flatnonzero(size)
    out = np.zeros((len(size), lanes), np.uint64)
    for k in range(lanes if len(some) else 0):
        total = _ones_in_each_bit(_lane(h, k), bounds[:-1][some])
        out[some, k] = np.packbits(2 * total > size[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each set of shingle hashes, none of them empty, one key for each band: the smallest values under as many scramblings
    as the band has hashes."""
    key = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(bounds) - 1, axis=0)
    for k in range(BAND_HASHES):
        least = np.stack([np.minimum.reduceat(h * f, bounds[:-1]) for f in _FACTORS[k::BAND_HASHES]], axis=1)
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + least)
    return key.view(np.int64)


@dataclass
class Prints:
    """Of whole texts the fingerprints of SHINGLE-word shingles, repeats included, the wide ones of the distinct WIDE_SHINGLE-word
    shingles, these shingles' bands (None of a text without words) and their numbers."""

    fp: np.ndarray
    wide: np.ndarray
    bands: list[np.ndarray | None]
    size: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Prints:
        fours, bounds = _shingle_hashes(texts, SHINGLE)
        sets = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):  # a shingle of one word more is told by two neighbours
            h = fours[a:b]
            x = np.sort(mix64(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]) if len(h) > 1 else h)
            sets.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x)
        size = np.array([len(x) for x in sets], np.int64)
        distinct, starts = np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        keys = iter(bands(distinct, np.append(starts[:-1][size > 0], len(distinct))) if len(distinct) else ())
        return cls(_simhashes(fours, bounds, 1)[:, 0], _simhashes(distinct, starts, LANES), [next(keys) if n else None for n in size.tolist()], size)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    return int(fingerprint_lanes(text, shingle)[0])


def fingerprint_column(text: str = "text", shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed bigint."""

    def prints(texts):
        return pd.Series(_simhashes(*_shingle_hashes(texts.tolist(), shingle), 1)[:, 0].view(np.int64))

    prints.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(prints, "bigint")(F.col(text).cast("string"))


def prints_column(text: str = "text") -> Column:
    """fp, w0 to w3 (the wide fingerprint), bands (null of a text without words) and size (distinct shingles) of each whole text."""

    def prints(texts):
        p = Prints.of(texts.tolist())
        return pd.DataFrame({"fp": p.fp.view(np.int64)} | {f"w{k}": p.wide[:, k].copy().view(np.int64) for k in range(LANES)} | {"bands": p.bands, "size": p.size})

    prints.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    fields = ", ".join(f"w{k} bigint" for k in range(LANES))
    return F.pandas_udf(prints, f"fp bigint, {fields}, bands array<bigint>, size bigint")(F.col(text).cast("string"))


def _planes(prints: np.ndarray, spare: int) -> np.ndarray:
    """A plane of words for each bit; lane i of the words is row i. ``spare`` empty words follow."""
    n = len(prints)
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    out = np.zeros((bits.shape[1], (n + 63) // 64 + spare), np.uint64)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    out.view(np.uint8)[:, : packed.shape[1]] = packed
    return out


def _lanes(mask: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    packed = np.packbits(mask, bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


def _over(counters: list[np.ndarray], sticky: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    above, equal = sticky.copy(), np.full_like(sticky, _ONES)
    for b in range(len(counters) - 1, -1, -1):
        if radius >> b & 1:
            equal &= counters[b]
        else:
            above |= equal & counters[b]
            equal &= ~counters[b]
    return above


def _near(planes: np.ndarray, shifts: np.ndarray, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i among the wanted lanes (shift, word) whose row i + shift differs in at most radius bits, and their shifts."""
    which, at = np.nonzero(wanted)
    want = wanted[which, at]
    shift = shifts[which]
    other, bits = at + shift // 64, (shift % 64).astype(np.uint64)
    up = np.uint64(63) - bits
    counters = [np.zeros(len(at), np.uint64) for _ in range(max(1, radius.bit_length()))]
    sticky = np.zeros(len(at), np.uint64)
    one = np.uint64(1)
    for k in range(len(planes)):
        plane = planes[k]
        carry = plane[at] ^ ((plane[other] >> bits) | ((plane[other + 1] << one) << up))
        for c in counters:
            both = c & carry
            c ^= carry
            carry = both
        sticky |= carry
        if k % 8 == 7:
            alive = np.flatnonzero(want & ~_over(counters, sticky, radius))
            if len(alive) < 0.9 * len(at):
                which, at, want, shift, other, bits, up, sticky = (x[alive] for x in (which, at, want, shift, other, bits, up, sticky))
                counters = [c[alive] for c in counters]
                if not len(at):
                    break
    hit = want & ~_over(counters, sticky, radius)
    lane = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))
    return at[lane // 64] * 64 + lane % 64, shift[lane // 64]


def link_forest(groups: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (print, print) that join what is linked within each group."""
    parent = forest(groups, prints, radius)
    child = np.flatnonzero(parent != np.arange(len(parent)))
    return prints[child], prints[parent[child]]


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first row of each row's component after the pairs are joined."""
    while True:
        a_root, b_root = parent[a], parent[b]
        apart = a_root != b_root
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a_root, b_root)[apart], np.minimum(a_root, b_root)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def forest(groups: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """Of each row the first row of its component, by the links within each group; rows of a group stand together.

    Many shifts are compared at once. Rows already joined are not compared again, which changes no component.
    """
    parent = np.arange(len(groups))
    rows, shift, planes = np.arange(len(groups)), 1, None
    while shift < len(rows):
        if shift & (shift - 1) == 0:
            # keep the groups that still reach so far and are not one component yet; a group's rows go or stay together
            first = np.concatenate(([True], groups[rows[1:]] != groups[rows[:-1]]))
            group = np.cumsum(first) - 1
            size, roots = np.bincount(group), parent[rows]
            mixed = np.bincount(group, weights=roots != roots[np.flatnonzero(first)][group]) > 0
            stay = (mixed & (size > shift))[group]
            if planes is None or not stay.all():
                rows = rows[stay]
                if shift >= len(rows):
                    break
                words = (len(rows) + 63) // 64
                planes = _planes(prints[rows], words + 2)
        lot = min(max(1, SHIFTS_AT_ONCE // words), (1 << shift.bit_length()) - shift, len(rows) - shift)
        wanted, g, r = np.zeros((lot, words), np.uint64), groups[rows], parent[rows]
        for k in range(lot):
            d = shift + k
            wanted[k] = _lanes((g[:-d] == g[d:]) & (r[:-d] != r[d:]), words)
        i, d = _near(planes, np.arange(shift, shift + lot), wanted, radius)
        if len(i):
            parent = _join(parent, rows[i], rows[i + d])
        shift += lot
    return parent


Compare = Callable[[DataFrame], DataFrame]
_EDGES = "u bigint, v bigint, bucket bigint"
_SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("bucket", pa.int64())])


def _told(groups: np.ndarray, buckets: np.ndarray, large: np.ndarray, nodes: np.ndarray, parent: np.ndarray) -> pa.RecordBatch:
    """Edges (u > v) of a forest, and for each row of a part of a large bucket that is not in one component with the part's
    smallest node, which is the bucket's: node, null, bucket."""
    child = np.flatnonzero(parent != np.arange(len(parent)))
    a, b = nodes[child], nodes[parent[child]]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(groups)), bool), groups[1:] != groups[:-1])))
    size = np.diff(np.append(first, len(groups)))
    pivot = np.lexsort((nodes, groups))[first] if len(groups) else first  # groups stand in order
    rest = np.flatnonzero((large != 0) & (parent != np.repeat(parent[pivot], size)))
    u, v = np.concatenate((np.maximum(a, b), nodes[rest])), np.concatenate((np.minimum(a, b), np.zeros(len(rest), np.int64)))
    none = np.arange(len(u)) >= len(a)
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v, mask=none), pa.array(np.concatenate((np.zeros(len(a), np.int64), buckets[rest])), mask=~none)], schema=_SCHEMA)


def _spanned(keyed: DataFrame, compare: Compare, most_rows: int, most_size: int = 1 << 62) -> DataFrame:
    """Edges (u > v) that span the links inside each bucket of ``keyed`` (bucket, node, size: one row each).

    ``compare`` gives what ``_told`` says of each group of (group, bucket, large, node). A bucket is a group; one of more than
    ``most_rows`` nodes or a greater size is dealt into parts, which all have its first node. Nodes in one component
    with the first are not compared again, the others are, with each part.
    """
    total = max(1, keyed.count())
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("count"), F.sum("size").alias("all"), F.min("node").alias("pivot")).where("count > 1")
    sizes = written(sizes.withColumn("parts", F.greatest(F.ceil(F.col("count") / most_rows), F.ceil(F.col("all") / most_size)).cast("int")), "buckets")
    rows = join_hot(keyed.select("bucket", "node"), sizes.drop("all"), "bucket", total)
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    large = sizes.where("parts > 1")
    pivots = large.select("bucket", F.col("pivot").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts")
    dealt = rows.where("parts = 1 OR node != pivot").select("bucket", "node", part.alias("part"), "parts").unionByName(pivots)
    first = written(compare(dealt.select(F.xxhash64("bucket", "part").alias("group"), "bucket", (F.col("parts") > 1).cast("bigint").alias("large"), "node")), "edges")
    edges = first.where("v IS NOT NULL").select("u", "v")
    rest = first.where("v IS NULL").select("bucket", F.col("u").alias("node")).distinct()
    left = rest.groupBy("bucket").agg(F.count("*").alias("n")).join(large.select("bucket", "count", "parts"), "bucket")
    left = written(left.select("bucket", "count", "parts", F.ceil(F.col("parts") * F.col("n") / F.col("count")).cast("int").alias("lots")), "rest")
    if not left.isEmpty():
        every, some = join_hot(keyed.select("bucket", "node"), left, "bucket", total), join_hot(rest, left, "bucket", total)
        lot = F.pmod(F.xxhash64("node", F.lit(1)), F.col("lots")).cast("int")
        across = every.select("bucket", "node", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
        along = some.select("bucket", "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), lot.alias("lot"))
        pairs = across.unionByName(along).select(F.xxhash64("bucket", "part", "lot", F.lit(2)).alias("group"), "bucket", F.lit(0).cast("bigint").alias("large"), "node").distinct()
        more = written(compare(pairs), "edges")
        edges = edges.union(more.select("u", "v"))
    return edges


def _sliced(radius: int, lanes: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (group, bucket, large, node, lanes of the fingerprint), sorted by group, what ``_told`` says of each group."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lot(rows: np.ndarray) -> pa.RecordBatch:
            return _told(*rows[:, :4].T, forest(rows[:, 0], np.ascontiguousarray(rows[:, 4:]).view(np.uint64), radius))

        held, size = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy() for k in range(4 + len(lanes))], axis=1))
            size += len(held[-1])
            if size >= LOT:
                rows = np.concatenate(held)
                cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
                if cut:
                    yield lot(rows[:cut])
                held, size = [rows[cut:]], len(rows) - cut
        if size:
            yield lot(np.concatenate(held))

    return compare


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """The least number of bit blocks by which a bucket has BUCKET_MEAN of ``n`` unrelated fingerprints at most."""
    blocks = max(BLOCKS, radius + 2)
    while blocks < MOST_BLOCKS and n >> (64 * (blocks - radius) // blocks) > BUCKET_MEAN:
        blocks += 1
    return blocks


def near_edges(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (u > v) between different fingerprints that span all links; ``prints`` has distinct values in column fp.
    ``blocks``: None for as many as their number asks for; any number above the radius gives the same components."""
    blocks = blocks_for(prints.count(), radius) if blocks is None else blocks
    if not 0 <= radius < blocks <= 64:
        raise ValueError("blocks must exceed radius")
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])]
    keys = [F.xxhash64(F.lit(k), *(part[i] for i in chosen)) for k, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    keyed = prints.select(F.explode(F.array(*keys)).alias("bucket"), F.col("fp").alias("node"), F.lit(1).alias("size"))

    def compare(groups: DataFrame) -> DataFrame:
        rows = groups.select("group", "bucket", "large", "node", F.col("node").alias("fp")).repartition("group").sortWithinPartitions("group")
        return rows.mapInArrow(_sliced(radius, ["fp"]), _EDGES)

    return _spanned(keyed, compare, bucket_rows)


def wide_edges(prints: DataFrame, radius: int = WIDE_RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Candidate edges (u > v) between nodes that share a band and whose wide fingerprints are near; ``prints`` has node, bands
    and the lanes, one row a node."""
    lanes = [f"w{k}" for k in range(LANES)]
    keyed = prints.select(F.explode("bands").alias("bucket"), "node", F.lit(1).alias("size"))

    def compare(groups: DataFrame) -> DataFrame:
        rows = groups.join(prints.select("node", *lanes), "node").select("group", "bucket", "large", "node", *lanes)
        return rows.repartition("group").sortWithinPartitions("group").mapInArrow(_sliced(radius, lanes), _EDGES)

    return _spanned(keyed, compare, bucket_rows)


def alike_forest(groups: np.ndarray, sets: list[np.ndarray], alike: tuple[int, int] = ALIKE) -> tuple[list[int], list[int]]:
    """Edges (row, row) that join within each group what has the exact Jaccard similarity; rows of a group stand together.

    From each row reached its intersections with all rows of the group are counted at once, until the group is one.
    """
    child, parent = [], []
    edge = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True])))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        size = np.array([len(x) for x in sets[a:b]], np.int64)
        flat = np.concatenate(sets[a:b])
        row = np.repeat(np.arange(b - a), size)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        open_ = np.ones(b - a, bool)
        while len(rest := np.flatnonzero(open_)) > 1:
            stack = [int(rest[0])]
            open_[rest[0]] = False
            while stack and open_.any():
                i = stack.pop()
                lo, hi = np.searchsorted(flat, sets[a + i]), np.searchsorted(flat, sets[a + i], side="right")
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange(int((hi - lo).sum())) if len(lo) else lo
                both = np.bincount(row[at], minlength=b - a)
                union = size + size[i] - both
                near = np.flatnonzero(open_ & (alike[1] * both >= alike[0] * union))
                open_[near] = False
                stack += near.tolist()
                child += (near + a).tolist()
                parent += [a + i] * len(near)
    return child, parent


def alike_edges(texts: DataFrame, clusters: DataFrame, shingle: int = WIDE_SHINGLE, rows: int = ALIKE_ROWS) -> DataFrame:
    """Edges (u > v) that span, inside each cluster, the pairs whose shingle sets have a Jaccard similarity of ALIKE or more.

    ``texts``: node and text, also repeated; ``clusters``: node, root and size (of the shingle set), one row a node.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lot() -> pa.RecordBatch:
            of = np.array(groups, np.int64)
            child, parent = (np.array(x, np.int64) for x in alike_forest(of, sets))
            return _told(of, *(np.array(x, np.int64) for x in (buckets, larges, nodes)), _join(np.arange(len(of)), child, parent))

        groups, buckets, larges, nodes, sets, held, there = [], [], [], [], [], 0, set()
        for batch in batches:
            for group, bucket, large, node, text in zip(*(batch.column(c).to_pylist() for c in ("group", "bucket", "large", "node", "text"))):
                if groups and group != groups[-1]:
                    there = set()
                    if held > ALIKE_BYTES:
                        yield lot()
                        groups, buckets, larges, nodes, sets, held = [], [], [], [], [], 0
                if node in there:
                    continue
                there.add(node)
                groups.append(group)
                buckets.append(bucket)
                larges.append(large)
                nodes.append(node)
                sets.append(shingle_set(text, shingle))
                held += sets[-1].nbytes
        if len(groups) > 1:
            yield lot()

    def compare(groups: DataFrame) -> DataFrame:
        found = groups.join(texts.select("node", "text"), "node").select("group", "bucket", "large", "node", "text")
        return found.repartition("group").sortWithinPartitions("group").mapInArrow(compared, _EDGES)

    size = F.col("size") if "size" in clusters.columns else F.lit(1)
    return _spanned(clusters.select(F.col("root").alias("bucket"), "node", size.alias("size")), compare, rows, ALIKE_BYTES // 8)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (u > v) reaches. Alternating large and small stars, until
    nothing but stars is left; each half of a round is a table in the shared folder, so nothing is recomputed beyond it."""
    now = written(edges.select("u", "v").distinct(), "edges")
    while True:
        total = 2 * now.count()
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"), F.count("*").alias("count"))
        if near.where("m < u AND m < most").isEmpty():  # every node is a centre or has one neighbour, a centre
            break
        least = near.select("u", F.least("u", "m").alias("m"), "count")
        large = written(join_hot(both, least, "u", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("count"))
        small = join_hot(large, least, "u", total).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.union(least.select("u", F.col("m").alias("v"))), "edges")
        forget(large, now)
        now = after
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
    out.shared_path = now.shared_path
    return out


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, blocks: int | None = None, shingle: int = SHINGLE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fp (bigint), component_id of every document: the smallest doc_id that its links reach, itself included.

    Null text and text without words have fingerprint zero and are linked like any other. Null doc_id: the row is kept,
    and never names a component; a component without any id has a null component_id. Repeated rows keep a row each, and
    equal ids need no order. Very long texts are hashed in pieces. Empty input: no row. Other columns, whatever their
    names, are not read.
    """
    small_batches(docs.sparkSession)
    keyed = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(text, shingle).alias("fp")), "fingerprints")
    total = max(1, keyed.count())
    prints = written(keyed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("count")), "prints")
    small_batches(docs.sparkSession, 8192)
    near = near_edges(prints.select("fp"), radius, blocks, bucket_rows)
    roots = components(near)
    rooted = prints.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "count", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("count"))
    labels = join_hot(rooted.select("root", "fp", F.col("count").alias("copies")), names, "root", total).select("fp", "component_id", F.col("copies").alias("count"))
    labels = written(labels, "labels")
    forget(near, roots, prints)
    return join_hot(keyed, labels, "fp", total).select("doc_id", "fp", "component_id")


def hex16(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, wide_radius: int = WIDE_RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The documents of which one stays for each group: the row with the smallest doc_id; of repeated rows one.

    A group is what links join: fingerprints of four-word shingles within ``radius`` bits, and texts whose sets of five-word
    shingles have an exact Jaccard similarity of 0.8 or more. Texts without words are alike. A row without an id stays
    only if no row of its group has one; of such rows the one with the smaller text hash. Equal ids: a text each. Texts are
    the same if two 64-bit hashes of them are. Very long texts are hashed in pieces. Empty input: no row. Columns are
    those of the input, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    hashes = (F.xxhash64(F.col(text).cast("string")), F.xxhash64(F.lit(1), F.col(text).cast("string")))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), hashes[0].alias("node"), hashes[1].alias("again"), prints_column(text).alias("p"))
    keyed = written(keyed.select("doc_id", "node", "again", "p.*"), "fingerprints")
    small_batches(spark, 2048)
    same = [c for c in keyed.columns if c != "doc_id"]
    every = written(keyed.groupBy(*same).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "texts")
    # two texts of one hash are told apart by the other: the first stands in the comparisons, the others are groups of their own
    twins = every.groupBy("node").agg(F.min("again").alias("main"), F.count("*").alias("n")).where("n > 1").drop("n")
    texts = every.join(twins, "node", "left").where("main IS NULL OR main = again").drop("main")
    first = written(texts.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("count")), "prints")
    total = max(1, every.count())
    copies = join_hot(texts.select("fp", "node"), first.withColumnRenamed("node", "first"), "fp", total).where("node != first").select(F.greatest("node", "first").alias("u"), F.least("node", "first").alias("v"))
    near = near_edges(first.select("fp"), radius, bucket_rows=bucket_rows)
    made = near.join(first.select(F.col("fp").alias("u"), F.col("node").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("node").alias("b")), "v")
    close = copies.union(made.select(F.greatest("a", "b"), F.least("a", "b")))
    wide = written(texts.select("node", "bands", *(f"w{k}" for k in range(LANES))), "wide")
    candidates = wide_edges(wide, wide_radius, bucket_rows=bucket_rows)
    members = components(candidates)
    forget(candidates, wide)
    clusters = members.union(members.select(F.col("root").alias("node"), "root").distinct())
    null, zero = F.isnull("least").alias("none"), F.coalesce("least", F.lit(0)).alias("id")
    clusters = written(clusters.join(texts.select("node", "again", "size", null, zero), "node"), "clusters")
    small_batches(spark)
    named = docs.select(F.isnull(doc_id).alias("none"), F.coalesce(F.col(doc_id), F.lit(0)).alias("id"), hashes[0].alias("node"), hashes[1].alias("again"), F.col(text).cast("string").alias("text"))
    wanted = clusters.select("none", "id", "node", "again")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    found = written(named.join(wanted, wanted.columns, "left_semi").dropDuplicates(["node"]).select("node", "text"), "members")
    alike = alike_edges(found, clusters)
    forget(members, clusters, found)
    small_batches(spark, 2048)
    roots = components(close.union(alike).distinct())
    grouped = every.join(roots, "node", "left").join(twins, "node", "left")
    odd = F.when(F.col("main").isNotNull() & (F.col("main") != F.col("again")), F.col("again"))
    grouped = grouped.select(F.when(odd.isNull(), F.coalesce("root", "node")).otherwise(F.col("node")).alias("root"), odd.alias("odd"), null, zero, "node", "again")
    keys = fresh(docs, "none", "id", "node", "again")
    keep = grouped.groupBy("root", "odd").agg(F.min(F.struct("none", "id", "node", "again")).alias("s")).select(*(F.col(f"s.{f}").alias(k) for f, k in zip(("none", "id", "node", "again"), keys)))
    keep = written(keep, "kept")
    forget(near, first, alike, roots, every, keyed)
    mine = dict(zip(keys, (F.isnull(doc_id), F.coalesce(F.col(doc_id), F.lit(0)), *hashes)))
    once = docs.select("*", *(c.alias(k) for k, c in mine.items())).dropDuplicates(keys)  # before the shuffle too, so repeated rows are no task's load
    return once.join(keep, keys, "left_semi").select(*(F.col(quoted(c)) for c in docs.columns))
