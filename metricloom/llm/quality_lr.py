"""Quality rules: plain counts, and a logistic regression on hashed word and character n-grams.

The regression's inputs are shares: of a text's words the share in each bucket (words and pairs of words), of its bytes
the share in each bucket (runs of three and four). It is fitted on labelled rows, made into probabilities by a logistic
curve on rows kept aside, and held against a fixed threshold. Of equal windows the words themselves are compared, not
their hashes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, WORD_SPACE, flat_bytes, lbfgs, mix64, platt, release, sampled_labels, sigmoid, small_batches, texts_of

BITS = 16
MOST_LABELLED = 2500
ROUNDS = 40
#: Weight of half the squared coefficients against the mean loss of a row.
PRIOR = 1e-6
#: A text stays if its calibrated probability of label 1 is at least this.
KEEP = 0.5
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of the words
WINDOW = 5
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_RUN3 = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_RUN4 = np.array([0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5], np.uint32)


def _runs(data: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Bucket of the run of bytes that begins at each byte, as far as one does."""
    n = len(data) - len(factors) + 1
    wide = data.astype(np.uint32) + np.uint32(1)
    h = wide[:n] * factors[0]
    for k in range(1, len(factors)):
        h = h + wide[k : k + n] * factors[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


@dataclass
class Lot:
    """What a batch of texts has, in flat arrays. Equal words, and no others, have the same number within the lot."""

    data: np.ndarray
    starts: np.ndarray
    words: np.ndarray
    hashes: np.ndarray
    word_doc: np.ndarray
    n_words: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Lot:
        import xxhash

        data, starts = flat_bytes(texts)
        raw = data.tobytes()
        split = [raw[a : b - 1].split() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]  # of bytes: ASCII white space
        n_words = np.array([len(w) for w in split], np.int64)
        number = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        words = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(n_words.sum()))
        each = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
        return cls(data, starts, words, each[words], np.repeat(np.arange(len(texts)), n_words), n_words)

    def features(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each kind of feature: buckets, their documents, and how many a document has."""
        n = len(self.starts) - 1
        shift = np.uint64(64 - BITS)
        out = [((mix64(self.hashes + np.uint64(1)) >> shift).astype(np.int32), self.word_doc, self.n_words)]
        pair = self.word_doc[1:] == self.word_doc[:-1]
        both = mix64(self.hashes[1:] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[:-1])[pair]
        out.append(((both >> shift).astype(np.int32), self.word_doc[1:][pair], np.maximum(self.n_words - 1, 0)))
        size = np.diff(self.starts)
        doc = np.repeat(np.arange(n), size)
        for factors in (_RUN3, _RUN4):
            if len(self.data) >= len(factors):
                buckets = _runs(self.data, factors)
                inside = doc[: len(buckets)] == doc[len(factors) - 1 :]
                out.append((buckets[inside], doc[: len(buckets)][inside], size))
        return out

    def repeated(self, window: int = WINDOW) -> np.ndarray:
        """Of each text the words in windows that the text has twice or more, the first included. Windows of one hash are
        compared word by word."""
        n, words = len(self.n_words), len(self.words)
        if words < window:
            return np.zeros(n, np.int64)
        ends = words - window + 1
        h = self.word_doc[:ends].astype(np.uint64)
        for k in range(window):
            h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + self.words[k : k + ends].astype(np.uint64))
        inside = np.flatnonzero(self.word_doc[:ends] == self.word_doc[window - 1 :])
        order = np.argsort(h[inside], kind="stable")
        same = h[inside][order][1:] == h[inside][order][:-1]
        at = inside[order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]]  # no other window can have an equal one
        whole = np.stack([self.word_doc[at], *(self.words[at + k] for k in range(window))])
        order = np.lexsort(whole)
        same = (whole[:, order][:, 1:] == whole[:, order][:, :-1]).all(axis=0)
        at = at[order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]] if len(at) else at
        cover = np.zeros(words + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
        return np.bincount(self.word_doc, weights=np.cumsum(cover[:-1]) > 0, minlength=n).astype(np.int64)

    def counts(self, texts: list[str]) -> dict[str, np.ndarray]:
        first = (self.data & 0xC0) != 0x80
        per = lambda mask: np.add.reduceat(np.append(mask, False).astype(np.int64), self.starts[:-1]) if len(texts) else np.zeros(0, np.int64)
        return {"n_words": self.n_words, "word_chars": per(first & ~IS_SPACE[self.data]), "n_symbols": per(_SYMBOL[self.data]), "n_dup_lines": np.array([_dup_lines(t) for t in texts], np.int64), "n_repeat_words": self.repeated()}


def _dup_lines(text: str) -> int:
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.strip(WORD_SPACE)]
    return len(lines) - len(set(lines))


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # kind, bucket
    bias: float
    slope: float
    offset: float

    def probability(self, lot: Lot) -> np.ndarray:
        n = len(lot.starts) - 1
        z = np.full(n, self.bias)
        for w, (buckets, doc, size) in zip(self.weights, lot.features()):
            z += np.bincount(doc, weights=w[buckets], minlength=n) / np.maximum(size, 1)
        return sigmoid(self.slope * z + self.offset)


def fit(rows: list[tuple[list[np.ndarray], list[np.ndarray]]], labels: np.ndarray, aside: np.ndarray, rounds: int = ROUNDS) -> QualityModel:
    """rows: of each document the buckets and shares of each kind. ``aside``: rows for the probabilities only."""
    kinds = 4
    weights = np.zeros((kinds, 1 << BITS))
    learn = np.flatnonzero(~aside)
    if not len(learn) or labels[learn].min() == labels[learn].max():  # nothing to tell apart: all stay
        return QualityModel(weights, 4.0, 1.0, 0.0)
    feature = np.concatenate([b.astype(np.int32) + (k << BITS) for bs, _ in rows for k, b in enumerate(bs)])
    share = np.concatenate([s for _, ss in rows for s in ss])
    size = np.array([sum(map(len, bs)) for bs, _ in rows], np.int64)
    known, place = np.unique(feature, return_inverse=True)
    doc, n = np.repeat(np.arange(len(rows), dtype=np.int32), size), len(rows)
    y, mine = labels.astype(np.float64), ~aside

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = x[-1] + np.bincount(doc, weights=x[place] * share, minlength=n)
        g = np.where(mine, sigmoid(z) - y, 0) / len(learn)
        grad = np.append(np.bincount(place, weights=g[doc] * share, minlength=len(known)), g.sum())
        grad[:-1] += PRIOR * x[:-1]
        return float(np.logaddexp(0, np.where(y > 0, -z, z))[learn].mean() + PRIOR / 2 * x[:-1] @ x[:-1]), grad

    x = lbfgs(loss, np.append(np.zeros(len(known)), np.log((y[learn].mean() + 1e-3) / (1 - y[learn].mean() + 1e-3))), rounds)
    w = np.zeros(kinds << BITS)
    w[known], b = x[:-1], x[-1:]
    z = b[0] + np.bincount(doc, weights=x[place] * share, minlength=n)
    slope, offset = platt(z[aside], y[aside]) if aside.any() else (1.0, 0.0)
    if slope <= 0:
        slope, offset = 1.0, 0.0
    return QualityModel(w.reshape(kinds, -1).astype(np.float32), float(b[0]), slope, offset)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", most: int = MOST_LABELLED) -> QualityModel:
    """Learns from at most ``most`` labelled documents; every fifth is kept aside for the probabilities."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t in texts_of(batch):
                kinds = []
                for buckets, _, size in Lot.of([t]).features():
                    ids, counts = np.unique(buckets, return_counts=True)
                    kinds.append((len(ids), ids.astype("<u2"), (counts / max(1, int(size[0]))).astype("<f4")))
                made.append(tuple(b"".join(x.tobytes() for x in col) for col in ([np.array([k[0] for k in kinds], "<i4")], [k[1] for k in kinds], [k[2] for k in kinds])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *(pa.array([m[k] for m in made], pa.binary()) for k in range(3))], ["doc_id", "label", "sizes", "buckets", "shares"])

    sample = sampled_labels(labels, docs, label, most, None, doc_id, text)
    got = sample.mapInArrow(rows, "doc_id bigint, label int, sizes binary, buckets binary, shares binary").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("buckets", "ascending")]) if got.num_rows else got
    made = []
    for s, b, v in zip(*(got[c].to_pylist() for c in ("sizes", "buckets", "shares"))):
        cuts = np.cumsum(np.frombuffer(s, "<i4"))[:-1]
        made.append((np.split(np.frombuffer(b, "<u2"), cuts), np.split(np.frombuffer(v, "<f4"), cuts)))
    y = (got["label"].to_numpy() > 0).astype(int) if got.num_rows else np.zeros(0, int)
    model = fit(made, y, np.arange(len(made)) % 5 == 4)
    del got, made
    release()
    return model


def quality(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability of every row.

    Null text: no word, so the base rules fail it. Null ids and repeated rows: a row each; a probability of exactly ``keep``
    stays. Very long texts are judged whole, in one batch of their own, with memory in proportion. Empty input: no row.
    Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            if not texts:
                continue
            lot = Lot.of(texts)
            counts, p = lot.counts(texts), shared.value.probability(lot)
            failed = base_failed(counts)
            columns = {"doc_id": batch.column("doc_id")} | {k: pa.array(v) for k, v in counts.items()}
            yield pa.RecordBatch.from_pydict(columns | {"base_failed": pa.array(failed), "kept": pa.array(~failed & (p >= keep)), "probability": pa.array(p)})

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(judge, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, probability double")
