"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of its hashed lower-case words and
their beginnings, the document's is their noisy-or, 1 - prod(1 - p). Only documents have labels: the gradient of the noisy-or hands each
document's error to the sentences that caused it, so the trained model also says which sentences offend. While fitting,
the noisy-or has a leak, a learned probability of the label without any cause in the text, which takes up labels that no
sentence explains; the score leaves it out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Adam, flat_bytes, release, sampled_labels, sigmoid, small_batches, span_hashes, texts_of

BITS = 18
#: Labelled documents that the model is fitted on, at most.
MOST_LABELLED = 3000
#: Bytes of a word's beginnings that are features beside the word itself.
BEGINNINGS = (4, 5, 6, 7)
#: A word counts if at least so many different sample texts have it.
LEAST_TEXTS = 6
#: Nats that a unit of weight must save over all documents.
PRICE = 0.2
ROUNDS = 200
THRESHOLD = 0.7
#: Sentences from this probability on are reported.
OFFENDING = 0.5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


def sentence_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sentence number of each word and of each word's beginnings, and where each sentence ends. The data must
    end with a newline."""
    letter = _LETTER[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    stop = _END[data]
    sentence = np.cumsum(stop, dtype=np.int32)[starts]
    from_, to, at = [starts], [ends], [sentence]
    for k in BEGINNINGS:
        longer = ends - starts > k
        from_.append(starts[longer])
        to.append(starts[longer] + k)
        at.append(sentence[longer])
    h = span_hashes(_LOWER[data], np.concatenate(from_), np.concatenate(to))
    h[len(starts) :] ^= np.uint64(0x5BF03635D1D6A5B9)  # a beginning is not the word of the same letters
    return (h >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(at), np.flatnonzero(stop)


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Probability, end position and document of each sentence with a word, and the documents' start positions."""
        data, starts = flat_bytes(texts)
        words, sentence, ends = sentence_words(data)
        n = len(ends)
        count = np.bincount(sentence, minlength=n)
        p = sigmoid(self.bias + np.bincount(sentence, weights=self.weights[words], minlength=n))
        p[count[:n] == 0] = 0.0
        return p, ends, np.searchsorted(starts, ends, side="right") - 1, starts

    def scores(self, texts: list[str]) -> np.ndarray:
        """The noisy-or of each whole text's sentences; 0 without a word."""
        p, _, doc, _ = self.sentences(texts)
        return 1.0 - np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(texts))) if texts else np.zeros(0)

    def offending(self, texts: list[str], least: float = OFFENDING) -> list[list[tuple[int, int, float]]]:
        """Of each text the sentences from ``least`` on: start, end (in characters of the text) and probability."""
        p, ends, doc, starts = self.sentences(texts)
        out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        last, raw = -1, b""
        for k in np.flatnonzero(p >= least).tolist():
            d = int(doc[k])
            if d != last:
                last, raw = d, texts[d].encode("utf-8", "surrogatepass")
            lo, hi = (int(ends[k - 1]) + 1 if k and doc[k - 1] == d else int(starts[d])) - int(starts[d]), int(ends[k]) + 1 - int(starts[d])
            begin = len(raw[:lo].decode("utf-8", "surrogatepass"))
            out[d].append((begin, begin + len(raw[lo:hi].decode("utf-8", "surrogatepass")), float(p[k])))
        return out


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = ROUNDS, price: float = PRICE) -> ToxicityModel:
    """Fits the noisy-or likelihood; a bag has the buckets and sentence numbers of a document's words."""
    weights = np.zeros(1 << BITS)
    if not len(bags) or labels.min() == labels.max():  # nothing to tell apart: a score near the share of the label
        return ToxicityModel(weights, -6.0)
    distinct: dict[bytes, int] = {}
    first = np.array([distinct.setdefault(w.tobytes(), k) == k for k, (w, _) in enumerate(bags)])
    texts = np.zeros(1 << BITS, np.int64)
    for k in np.flatnonzero(first):
        texts[np.unique(bags[k][0])] += 1
    known = np.flatnonzero(texts >= LEAST_TEXTS)
    place = np.full(1 << BITS, -1)
    place[known] = np.arange(len(known))
    words, sentence, doc, at = [], [], [], 0
    for k, (w, s) in enumerate(bags):
        names, local = np.unique(s, return_inverse=True)
        use = place[w] >= 0
        words.append(place[w[use]].astype(np.int32))
        sentence.append((local[use] + at).astype(np.int32))
        doc.append(np.full(len(names), k, np.int32))
        at += len(names)
    words, sentence, doc = np.concatenate(words), np.concatenate(sentence), np.concatenate(doc)
    y = labels.astype(np.float64)
    rate = y.mean()
    # the start: words that labelled texts have far more often than others, so that the noisy-or has something to sharpen
    seen = np.zeros((2, len(known)))
    for k, (name, _) in enumerate(bags):
        mine = place[np.unique(name)]
        seen[int(y[k]), mine[mine >= 0]] += 1
    odds = np.log((seen[1] + 0.5 * rate) / (y.sum() + rate)) - np.log((seen[0] + 0.5) / (len(y) - y.sum() + 1))
    w = np.where((odds > 1) & (seen[1] >= 2), odds, 0.0)
    b, leak = np.array([-5.0]), np.array([-3.0])
    step_w, step_b, step_leak = Adam(len(known), 0.1, price / len(bags)), Adam(1, 0.05), Adam(1, 0.05)
    for _ in range(rounds):
        p = sigmoid(b[0] + np.bincount(sentence, weights=w[words], minlength=at))
        free = sigmoid(leak[0])
        log_none = np.log1p(-free) + np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(bags))
        none = np.exp(log_none)
        pull = np.where(y > 0, -none / np.maximum(1e-6, -np.expm1(log_none)), 1.0) / len(bags)
        g = p * pull[doc]
        w = step_w.step(w, np.bincount(words, weights=g[sentence], minlength=len(known)))
        b = step_b.step(b, np.array([g.sum()]))
        leak = step_leak.step(leak, np.array([free * pull.sum()]))
    weights[known] = w
    return ToxicityModel(weights.astype(np.float32), float(b[0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", where: Column | None = None, doc_id: str = "doc_id", text: str = "text", most: int = MOST_LABELLED) -> ToxicityModel:
    """Learns from at most ``most`` labelled documents; ``where`` says which label rows may be learnt from."""
    small_batches(docs.sparkSession)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in texts_of(batch):
                w, s, _ = sentence_words(flat_bytes([t])[0])
                rows.append((w.astype("<i4").tobytes(), s.astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), batch.column("doc_id")], ["label", "words", "sentences", "doc_id"])

    sample = sampled_labels(labels, docs, label, most, where, doc_id, text)
    rows = sample.mapInArrow(bags, "label int, words binary, sentences binary, doc_id bigint").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("words", "ascending")]) if rows.num_rows else rows
    made = [(np.frombuffer(w, "<i4"), np.frombuffer(s, "<i4")) for w, s in zip(rows["words"].to_pylist(), rows["sentences"].to_pylist())]
    model = fit(made, (rows["label"].to_numpy() > 0).astype(int) if rows.num_rows else np.zeros(0, int))
    del rows, made
    release()
    return model


def score_column(model: ToxicityModel, spark, text: str = "text") -> Column:
    """The score of each whole text; null and empty texts have 0."""
    shared = spark.sparkContext.broadcast(model)

    def score(texts):
        return pd.Series(shared.value.scores([t or "" for t in texts]))

    score.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(score, "double")(F.col(text).cast("string"))


def offending_sentences(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", least: float = OFFENDING) -> DataFrame:
    """doc_id, start, end, sentence, score of every offending sentence. Null texts have none; repeated rows and null ids: rows
    each; very long texts whole; empty input: no row; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            rows = [(i, s, e, t[s:e], p) for i, t, found in zip(batch.column("doc_id").to_pylist(), texts, shared.value.offending(texts, least)) for s, e, p in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()))], ["doc_id", "start", "end", "sentence", "score"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(find, "doc_id bigint, start bigint, end bigint, sentence string, score double")


def score_documents(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, least: float = OFFENDING) -> DataFrame:
    """doc_id, score (0 to 1), predicted, and offending: start and end (characters of the text) and probability of each sentence
    from ``least`` on, of every row.

    Null text scores as empty, 0, without sentences. Repeated rows and null ids: a row each. A score of exactly the threshold
    is predicted 1. Very long texts are judged whole, in a batch of their own, with memory in proportion. Empty input: no
    row. Other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts):
        texts = [t or "" for t in texts]
        found = [[{"start": s, "end": e, "score": p} for s, e, p in f] for f in shared.value.offending(texts, least)]
        return pd.DataFrame({"score": shared.value.scores(texts), "offending": found})

    judge.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    kind = "score double, offending array<struct<start bigint, end bigint, score double>>"
    judged = docs.select(F.col(doc_id).alias("doc_id"), F.pandas_udf(judge, kind)(F.col(text).cast("string")).alias("j"))
    return judged.select("doc_id", "j.score", F.when(F.col("j.score") >= threshold, 1).otherwise(0).alias("predicted"), "j.offending")
