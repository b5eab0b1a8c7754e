"""Language identification word by word with a linear-chain conditional random field.

A word's features are itself (the lexicon), its beginnings and endings, and its runs of three and four bytes, hashed;
labels are languages, and transitions between the labels of neighbouring words are learnt with the features. Training
sequences are code-switched: stretches of different documents follow each other. A text's words are labelled by
forward-backward over the whole text, in two levels: products of the transfer matrices of fixed stretches, all at once,
then from stretch to stretch. A long text goes through in windows, which hand their messages on in both directions, so
memory beyond the text is one window's. The text's language is the one with the largest mean marginal, weighted by word
length. A run of letters of more than MOST_LETTERS bytes (a script without spaces) is several words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Adam, flat_bytes, release, small_batches, span_hashes, texts_of

BITS = 17
AFFIXES = (1, 2, 3)
RUNS = (3, 4)
#: Learnt from at most so many documents, of each of them from at most so many stretches, spread over the whole text.
MOST_LABELLED = 2400
STRETCHES = 4
STRETCH = 12
SEQUENCE = 48
ROUNDS = 40
#: Words of a stretch whose transfer matrices are multiplied in one go.
STEP = 32
UNKNOWN = "und"
#: Bytes of a word at most.
MOST_LETTERS = 48
#: Bytes of text whose words are held at once: of several texts, or of a window of one.
WINDOW = 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word, in bytes; a long run of letters is cut, not inside a character."""
    letter = _LETTER[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    parts = -(-(b - a) // MOST_LETTERS)
    if len(a) and parts.max() > 1:
        which = np.repeat(np.arange(len(a)), parts)
        a = a[which] + MOST_LETTERS * (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts))
        for _ in range(3):  # back to the first byte of a character
            a = a - ((data[a] & 0xC0) == 0x80)
        b = np.where(np.append(which[1:] == which[:-1], False), np.append(a[1:], 0), b[which])
        a, b = a[b > a], b[b > a]
    return a, b


@dataclass
class Words:
    doc: np.ndarray
    length: np.ndarray
    features: np.ndarray  # bucket of each feature
    owner: np.ndarray  # its word

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        data, bounds = flat_bytes(texts)
        return cls.within(data, bounds)

    @classmethod
    def within(cls, data: np.ndarray, bounds: np.ndarray, spans: tuple[np.ndarray, np.ndarray] | None = None) -> Words:
        a, b = word_spans(data) if spans is None else spans
        size, low = b - a, _LOWER[data]
        numbers = np.arange(len(a))
        from_, to, owner, kind = [a], [b], [numbers], [np.full(len(a), 0, np.uint64)]
        for n, k in enumerate(AFFIXES):
            some = numbers[size > k]
            from_ += (a[some], b[some] - k)
            to += (a[some] + k, b[some])
            owner += (some, some)
            kind += (np.full(len(some), 1 + n, np.uint64), np.full(len(some), 11 + n, np.uint64))
        for k in RUNS:
            count = np.maximum(size - k + 1, 0)
            which = np.repeat(numbers, count)
            start = a[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            from_.append(start)
            to.append(start + k)
            owner.append(which)
            kind.append(np.full(len(which), 20 + k, np.uint64))
        h = span_hashes(low, np.concatenate(from_), np.concatenate(to)) + np.concatenate(kind) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return cls(np.searchsorted(bounds, a, side="right") - 1, size, (h >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(owner))

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Mean weight of each word's features, times the square root of their number: long words weigh more, not in proportion."""
        n = len(self.doc)
        count = np.maximum(np.bincount(self.owner, minlength=n), 1)
        return np.stack([np.bincount(self.owner, weights=w[self.features], minlength=n) for w in weights], axis=1) / np.sqrt(count)[:, None]


def _products(grid: np.ndarray, real: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The product of the transfer matrices of each stretch of a grid (stretch, word, label)."""
    total, steps, k = grid.shape
    product = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(steps):
        some = real[:, t]
        if not some.any():
            break
        step = (product[some] @ move) * grid[some, t][:, None, :]
        product[some] = step / step.max(axis=(1, 2), keepdims=True)
    return product


def window_product(emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The product of the transfer matrices of all words of a window, but for its scale."""
    n, k = emission.shape
    grid, real = np.ones((-(-n // STEP) * STEP, k)), np.arange(-(-n // STEP) * STEP) < n
    grid[:n] = np.exp(emission - emission.max(axis=1, keepdims=True))
    out = np.eye(k)
    for m in _products(grid.reshape(-1, STEP, k), real.reshape(-1, STEP), np.exp(transition)):
        out = out @ m
        out /= out.max()
    return out


def marginals(emission: np.ndarray, doc: np.ndarray, transition: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities of each word given its whole text; ``doc`` is ascending. ``before`` and ``after``: the messages of what
    stands before and after the words of a single text's window."""
    n, k = emission.shape
    if not n:
        return emission
    potential = np.exp(emission - emission.max(axis=1, keepdims=True))
    move = np.exp(transition)
    docs, first, size = np.unique(doc, return_index=True, return_counts=True)
    stretches = -(-size // STEP)
    base = np.cumsum(stretches) - stretches
    total = int(stretches.sum())
    within = np.arange(n) - np.repeat(first, size)
    row, col = np.repeat(base, size) + within // STEP, within % STEP
    grid = np.zeros((total, STEP, k))
    real = np.zeros((total, STEP), bool)
    grid[row, col], real[row, col] = potential, True
    product = _products(grid, real, move)
    ahead, behind = np.ones((total, k)), np.ones((total, k))  # what comes before a stretch, what comes after it
    if before is not None:
        ahead[0], behind[-1] = before, after
    for s in range(1, int(stretches.max())):
        at = base[stretches > s] + s
        x = np.einsum("nk,nkj->nj", ahead[at - 1], product[at - 1])
        ahead[at] = x / x.max(axis=1, keepdims=True)
    for s in range(int(stretches.max()) - 2, -1, -1):
        at = base[stretches > s + 1] + s
        x = np.einsum("nkj,nj->nk", product[at + 1], behind[at + 1])
        behind[at] = x / x.max(axis=1, keepdims=True)
    forward = np.zeros_like(grid)
    state = ahead
    for t in range(STEP):
        x = (state @ move) * grid[:, t]
        x = np.where(real[:, t, None], x / np.maximum(x.max(axis=1, keepdims=True), 1e-300), state)
        forward[:, t] = state = x
    state = behind
    for t in range(STEP - 1, -1, -1):
        forward[:, t] *= state
        x = (grid[:, t] * state) @ move.T
        state = np.where(real[:, t, None], x / np.maximum(x.max(axis=1, keepdims=True), 1e-300), state)
    out = forward[row, col]
    return out / out.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    weights: np.ndarray  # label, bucket
    transition: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and its mean marginal; a text without a letter, or a model without labels: ``und`` and 0."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.labels or not texts:
            return names, scores
        sums = np.zeros((len(texts), len(self.labels)))
        held, size = [], 0
        for d, t in enumerate(texts):
            if len(t) > WINDOW:
                for _, length, p in self._windows(t):
                    sums[d] += length @ p
                continue
            held.append(d)
            size += len(t)
            if size > WINDOW:
                self._add(texts, held, sums)
                held, size = [], 0
        self._add(texts, held, sums)
        weight, best = sums.sum(axis=1), sums.argmax(axis=1)  # of equal sums the first label
        for d in np.flatnonzero(weight > 0).tolist():
            if any(c.isalpha() for c in texts[d]):
                names[d], scores[d] = self.labels[best[d]], min(1.0, sums[d, best[d]] / weight[d])
        return names, scores

    def _add(self, texts: list[str], which: list[int], sums: np.ndarray) -> None:
        words = Words.of([texts[d] for d in which])
        p = marginals(words.emissions(self.weights), words.doc, self.transition) * words.length[:, None]
        for k in range(len(self.labels)):
            sums[which, k] += np.bincount(words.doc, weights=p[:, k], minlength=len(which))

    def _windows(self, text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of a long text's windows in turn: where it starts, in bytes, the words' lengths and marginals given the whole text."""
        data = flat_bytes([text])[0]
        a, b = (x.astype(np.uint32 if len(data) < 1 << 32 else np.int64) for x in word_spans(data))
        cuts = np.unique(np.append(np.searchsorted(a, np.arange(0, len(data), WINDOW)), len(a)))
        parts = []
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            lo, hi = int(a[i]), int(b[j - 1])
            w = Words.within(data[lo:hi], np.array([0, hi - lo]), (a[i:j].astype(np.int64) - lo, b[i:j].astype(np.int64) - lo))
            parts.append((lo, w.length.astype(np.uint8), w.emissions(self.weights).astype(np.float32)))
        del a, b
        k = len(self.labels)
        products = [window_product(e.astype(np.float64), self.transition) for _, _, e in parts]
        behind = [np.ones(k)]
        for m in reversed(products[1:]):
            x = m @ behind[-1]
            behind.append(x / x.max())
        ahead = np.ones(k)
        for (a, length, e), m, after in zip(parts, products, reversed(behind)):
            yield a, length, marginals(e.astype(np.float64), np.zeros(len(e), np.int64), self.transition, ahead, after)
            ahead = ahead @ m
            ahead /= ahead.max()

    def label_words(self, text: str) -> list[tuple[int, int, str, float]]:
        """Each word of a text: start and end in UTF-8 bytes, language, probability."""
        if not self.labels:
            return []
        data, out = flat_bytes([text])[0], []
        spans = word_spans(data)
        p = np.concatenate([np.zeros((0, len(self.labels))), *(p for _, _, p in self._windows(text))])
        for a, b, r in zip(*spans, p):
            out.append((int(a), int(b), self.labels[int(r.argmax())], float(r.max())))
        return out


def fit(texts: list[str], langs: list[str], rounds: int = ROUNDS, seed: int = 7) -> LanguageModel:
    """Maximum likelihood of the labels of code-switched sequences made of the given stretches, with a weak prior."""
    labels = tuple(sorted(set(langs)))
    k = len(labels)
    if k < 2 or not any(texts):
        return LanguageModel(labels, np.zeros((k, 1 << BITS), np.float32), np.zeros((k, k)))
    order = np.random.default_rng(seed).permutation(len(texts))
    texts, names = [texts[i] for i in order], np.array([labels.index(langs[i]) for i in order])
    words = Words.of(texts)
    y = names[words.doc]
    n = len(y)
    sequence = np.arange(n) // SEQUENCE  # stretches follow each other; cuts fall where they fall
    count = np.maximum(np.bincount(words.owner, minlength=n), 1)
    scale = 1 / np.sqrt(count)
    weights, transition = np.zeros((k, 1 << BITS)), np.zeros((k, k))
    step_w, step_t = Adam(weights.shape, 0.15), Adam(transition.shape, 0.1)
    joined = sequence[1:] == sequence[:-1]
    target = np.zeros((k, k))
    np.add.at(target, (y[:-1][joined], y[1:][joined]), 1)
    hot = np.zeros((n, k))
    hot[np.arange(n), y] = 1
    for _ in range(rounds):
        emission = words.emissions(weights)
        p = marginals(emission, sequence, transition)
        g = (p - hot) * scale[:, None] / n
        grad = np.stack([np.bincount(words.features, weights=g[words.owner, j], minlength=1 << BITS) for j in range(k)])
        pairs = _pairs(emission, sequence, transition, joined)
        weights = step_w.step(weights, grad + 1e-8 * weights)
        transition = step_t.step(transition, (pairs - target) / n + 1e-4 * transition)
    return LanguageModel(labels, weights.astype(np.float32), transition)


def _pairs(emission: np.ndarray, sequence: np.ndarray, transition: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Expected transitions: forward and backward over sequences of SEQUENCE words."""
    n, k = emission.shape
    rows = -(-n // SEQUENCE)
    grid = np.ones((rows * SEQUENCE, k))
    grid[:n] = np.exp(emission - emission.max(axis=1, keepdims=True))
    grid, move = grid.reshape(rows, SEQUENCE, k), np.exp(transition)
    real = (np.arange(rows * SEQUENCE) < n).reshape(rows, SEQUENCE)
    back = np.ones((rows, SEQUENCE, k))
    for t in range(SEQUENCE - 2, -1, -1):
        x = (grid[:, t + 1] * back[:, t + 1]) @ move.T
        back[:, t] = np.where(real[:, t + 1, None], x / x.max(axis=1, keepdims=True), 1.0)
    total = np.zeros((k, k))
    state = np.ones((rows, k)) @ move * grid[:, 0]
    for t in range(1, SEQUENCE):
        both = state[:, :, None] * move * (grid[:, t] * back[:, t])[:, None, :]
        total += (both / both.sum(axis=(1, 2), keepdims=True))[real[:, t]].sum(axis=0)
        x = (state @ move) * grid[:, t]
        state = x / x.max(axis=1, keepdims=True)
    return total


def train(docs: DataFrame, where: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MOST_LABELLED) -> LanguageModel:
    """Learns from text and language of at most ``most`` documents, chosen by the hash of their texts among those with both."""
    small_batches(docs.sparkSession)
    rows = docs.where(where) if where is not None else docs
    rows = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).dropna(subset=["text", "lang"])
    # the least hash that some 4 * most rows reach is found from counts, so no sort holds texts
    keyed = rows.withColumn("h", F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 20)))
    n = rows.count()
    keyed = keyed.where(F.col("h") < min(1 << 20, int((1 << 20) * 2.0 * most / max(1, n)) + 1))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = batch.column("lang").to_pylist(), ([], [], [])
            for h, t, name in zip(batch.column("h").to_pylist(), texts_of(batch), langs):
                words = t.split()
                gap = max(1, len(words) // STRETCHES)
                for a in range(0, len(words), max(gap, STRETCH)):
                    out[0].append(h)
                    out[1].append(" ".join(words[a : a + STRETCH]))
                    out[2].append(name)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["h", "text", "lang"])

    got = keyed.select("h", "text", "lang").mapInArrow(stretches, "h bigint, text string, lang string").orderBy("h", "text", "lang").limit(most * STRETCHES).toArrow()
    model = fit(got["text"].to_pylist(), got["lang"].to_pylist())
    del got
    release()
    return model


def predict_languages(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row. Null text or no letter: ``und``, 0. Repeated rows and null ids: a row each. Of
    equally likely languages the first by name. Very long texts are judged whole, window by window. Empty input: no row.
    Other columns, whatever their names, are not read."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(judge, "doc_id bigint, lang_pred string, score double")
