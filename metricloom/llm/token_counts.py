"""Token counts by a map-side two-tier lookup.

Tier one is a table of the frequent pre-tokens' lengths, of a fixed number of entries, found over all texts and sent to
every worker. Tier two is each worker's own cache: a pre-token that neither knows is encoded by the library once. The
pre-tokens themselves are never shuffled: the frequent ones come from summaries of bounded size (Misra-Gries counters,
one for each partition), merged by a tree.
"""

import pickle
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .pieces import PieceEncoder, encoder, split

#: Entries of the broadcast table, pre-token and length; at some 30 bytes each it stays below 1 MB.
FREQUENT = 20_000
#: Longer pre-tokens are not kept as frequent, which bounds the table's bytes.
LONGEST = 24


def _pruned(counts: Counter, keep: int) -> Counter:
    """Misra-Gries: the count of the first entry that goes is taken from all that stay."""
    if len(counts) <= keep:
        return counts
    ranked = counts.most_common(keep + 1)
    least = ranked[-1][1]
    return Counter({k: v - least for k, v in ranked[:-1] if v > least})


def frequent_pieces(docs: DataFrame, text: str = "text", keep: int = FREQUENT) -> list[str]:
    """The frequent pre-tokens of all texts, at most ``keep``."""
    source = docs.select(F.col(text).cast("string").alias("text"))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            column = pc.fill_null(batch.column("text"), "")
            if len(column):
                codes, distinct, _ = split(column)
                counts.update(dict(zip(distinct.to_pylist(), np.bincount(codes, minlength=len(distinct)).tolist())))
            if len(counts) > 8 * keep:
                counts = _pruned(counts, 2 * keep)
        yield pa.RecordBatch.from_pydict({"summary": [pickle.dumps(dict(_pruned(Counter({k: v for k, v in counts.items() if len(k) <= LONGEST}), keep)))]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for s in batch.column(0).to_pylist():
                total.update(pickle.loads(s))
                total = _pruned(total, keep)
        if total:
            yield pa.RecordBatch.from_pydict({"summary": [pickle.dumps(dict(total))]})

    parts = source.mapInArrow(summarise, "summary binary")
    width = max(1, docs.sparkSession.sparkContext.defaultParallelism)
    merged = parts.repartition(width).mapInArrow(merge, "summary binary").repartition(1).mapInArrow(merge, "summary binary")
    found = merged.collect()  # one row of at most ``keep`` entries
    total = Counter(pickle.loads(found[0][0])) if found else Counter()
    return [k for k, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text", keep: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, as the library counts without added special tokens.

    Null text: empty, no token. Repeated rows: a row each. Null ids are kept. A count of exactly ``limit`` is not over it.
    Very long texts are cut up whole, in a lot of their own. Empty input: no row. Other columns, whatever their names, are
    not read. A sentencepiece ``.model`` is counted by its own library, text by text.
    """
    small_batches(docs.sparkSession, 2048, "8m")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    count = _piece_counter(rows, tokenizer, keep) if not tokenizer.endswith(".model") else _sentencepiece_counter(tokenizer)
    counted = rows.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.pandas_udf(count, "bigint")("text").alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def frequent_lengths(docs: DataFrame, tokenizer: str, text: str = "text", keep: int = FREQUENT) -> dict[str, int | None]:
    """Tokens of each frequent pre-token; None where only its whole text can tell. Each is encoded once, by the driver."""
    pieces = frequent_pieces(docs, text, keep)
    counter = PieceEncoder(tokenizer, lengths_only=True)
    return dict(zip(pieces, counter.lookup(pieces))) if counter.by_piece else {}


def _piece_counter(rows: DataFrame, tokenizer: str, keep: int):
    tier, key = rows.sparkSession.sparkContext.broadcast(frequent_lengths(rows, tokenizer, keep=keep)), uuid.uuid4().hex

    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(tokenizer, tier.value, key=key, lengths_only=True)
        return pd.Series(enc.encode(pa.Array.from_pandas(texts, type=pa.string())), dtype="int64")

    return count


def _sentencepiece_counter(model: str):
    def count(texts: pd.Series) -> pd.Series:
        import sentencepiece

        if model not in _MODELS:
            _MODELS[model] = sentencepiece.SentencePieceProcessor(model_file=model)
        return pd.Series([len(x) for x in _MODELS[model].encode(texts.tolist(), num_threads=1)], dtype="int64")

    return count


_MODELS: dict = {}
