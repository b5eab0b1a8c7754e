"""URL filters: rules first, then a ratio of two character language models.

Both models are smoothed variable-order Markov models over whole URLs from the host on: one of accepted URLs, one of
rejected ones, counted over every URL that a rule decides. A character's probability mixes all orders from the longest
context down, each order weighing in by how often its context was seen against how many different characters followed
it (Witten-Bell). The score is the difference of the log-likelihoods by length; a logistic curve turns it into a
probability, and URLs without a rule are blocked above a fixed one. The curve is fitted to the URLs of one hash part, all
of them, scored by models that have not counted that part; the models that judge have counted all.

The counts are a table with a row for each context and character that occurs, so it grows with the URLs. Up to
MOST_CELLS rows it is sent to the workers; a larger one is joined to the characters of the distinct URLs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, join_hot, platt, quoted, small_batches, written

ORDERS = 5  # contexts of 0 to 4 characters
SYMBOLS = 64
SYMBOL_BITS = 6
BLOCK_FROM = 0.5
#: One URL in so many, by hash, calibrates.
CALIBRATION_PART = 8
#: Rows of the table of counts that are broadcast at most, of some 40 bytes each.
MOST_CELLS = 1 << 20
#: Width and number of the bins that calibration counts scores in.
BIN, BINS = 0.005, 4096

#: The rules that the contract names: verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

_CLASS = np.full(256, SYMBOLS - 1, np.int64)
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789./-_~%:@!$&'()*+,;=[]|"):
    _CLASS[ord(_c)] = _k
for _c in range(65, 91):
    _CLASS[_c] = _c - 65


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: from there up to ``?``,
    ``#`` or the end. Null or without ``://``: both empty."""
    host, after = _host_and_rest(url)
    return host, F.regexp_extract(after, r"(?s)^([^?#]*)", 1)


def _host_and_rest(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, or null. Of equally long ones the one with the longer host, then the first."""
    out = F.lit(None)
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(out)
    return out


def _characters(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each order that each character of the URLs falls in (order, character), and the URL of each. A cell is the
    order, the characters before and the character; what stands before a URL is the last symbol."""
    raw = [u.encode("utf-8", "surrogatepass") for u in urls]
    size = np.array([len(r) for r in raw], np.int64)
    s = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(len(urls)), size)
    place = np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size)
    context, cells = np.zeros(len(s), np.int64), []
    for order in range(ORDERS):
        if order:
            before = np.full(len(s), SYMBOLS - 1, np.int64)
            inside = np.flatnonzero(place >= order)
            before[inside] = s[inside - order]
            context = context | before << (SYMBOL_BITS * (order - 1))
        cells.append(((order << (SYMBOL_BITS * (ORDERS - 1))) + context) << SYMBOL_BITS | s)
    return np.stack(cells) if len(s) else np.zeros((ORDERS, 0), np.int64), owner


@dataclass
class Counts:
    """Cells in order with the times that each was seen, and of their contexts the times and the different characters."""

    cells: np.ndarray
    n: np.ndarray

    def __post_init__(self):
        seen = self.n > 0
        self.cells, self.n = self.cells[seen], self.n[seen]
        context = self.cells >> SYMBOL_BITS
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.zeros(0, np.int64)
        self.contexts = context[first]
        self.seen = np.add.reduceat(self.n, first) if len(first) else np.zeros(0)
        self.kinds = np.diff(np.append(first, len(context)))

    @staticmethod
    def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    def log_likelihood(self, cells: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        p = np.full(cells.shape[1], 1.0 / SYMBOLS)
        for order in range(ORDERS):
            total, kinds = (self._found(self.contexts, x, cells[order] >> SYMBOL_BITS) for x in (self.seen, self.kinds))
            p = _mixed(self._found(self.cells, self.n, cells[order]), total, np.maximum(kinds, 1), p)
        return np.bincount(owner, weights=np.log(p), minlength=n)


def _mixed(n, total, kinds, lower):
    """The Witten-Bell mixture of an order with the orders below; an unseen context leaves it to these."""
    return (n + kinds * lower) / (total + kinds)


@dataclass(frozen=True)
class UrlModel:
    """Counts in memory, or where they are too many for that as a table (cell, accepted, rejected)."""

    accepted: Counts | None
    rejected: Counts | None
    table: DataFrame | None = None
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, urls: list[str]) -> np.ndarray:
        """Log-likelihood as rejected less that as accepted, by length."""
        cells, owner = _characters(urls)
        size = np.maximum(np.bincount(owner, minlength=len(urls)), 1)
        return (self.rejected.log_likelihood(cells, owner, len(urls)) - self.accepted.log_likelihood(cells, owner, len(urls))) / size

    def differences(self, rows: DataFrame, address: str, out: str) -> DataFrame:
        """``rows`` with a column of each address's difference."""
        if self.table is not None:
            return _joined_differences(rows, address, out, self.table)
        shared = rows.sparkSession.sparkContext.broadcast(UrlModel(self.accepted, self.rejected))

        def score(addresses):
            return pd.Series(shared.value.difference(addresses.tolist()), dtype=float)

        score.__annotations__ = {"addresses": pd.Series, "return": pd.Series}
        return rows.withColumn(out, F.pandas_udf(score, "double")(F.col(address)))


def _joined_differences(rows: DataFrame, address: str, out: str, table: DataFrame) -> DataFrame:
    """By joins: a row for each character of each distinct address, joined with the contexts of each order in turn."""
    each = ", ".join(f"c{k} bigint" for k in range(ORDERS))

    def characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                names = batch.column(0).slice(a, 512)
                cells, owner = _characters(names.to_pylist())
                yield pa.RecordBatch.from_arrays([names.take(pa.array(owner)), *(pa.array(c) for c in cells)], ["address", *(f"c{k}" for k in range(ORDERS))])

    distinct = rows.select(F.col(address).alias("address")).distinct()
    now = distinct.mapInArrow(characters, f"address string, {each}").withColumns({"good": F.lit(1.0 / SYMBOLS), "bad": F.lit(1.0 / SYMBOLS)})
    followers = F.map_from_entries(F.collect_list(F.struct("cell", F.struct("accepted", "rejected"))))  # of SYMBOLS entries at most
    kinds = lambda c: F.greatest(F.count(F.when(F.col(c) > 0, 1)), F.lit(1)).alias(f"{c}_kinds")
    contexts = table.groupBy(F.shiftright("cell", SYMBOL_BITS).alias("context")).agg(followers.alias("followers"), F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), kinds("accepted"), kinds("rejected"))
    contexts = written(contexts, "contexts")
    top = 1 << SYMBOL_BITS * (ORDERS - 1)
    total = contexts.where("context = 0").select(F.sum(F.col("accepted") + F.col("rejected"))).first()[0] or 1  # all characters
    for k in range(ORDERS):
        mine = contexts.where((F.col("context") >= k * top) & (F.col("context") < (k + 1) * top))
        now = join_hot(now.withColumn("context", F.shiftright(f"c{k}", SYMBOL_BITS)), mine.withColumn("count", F.col("accepted") + F.col("rejected")), "context", total, "left")
        seen = F.element_at("followers", F.col(f"c{k}"))
        mixed = {}
        for name, side in (("good", "accepted"), ("bad", "rejected")):
            n, all_, different = F.coalesce(seen[side], F.lit(0)), F.coalesce(side, F.lit(0)), F.coalesce(f"{side}_kinds", F.lit(1))
            mixed[name] = _mixed(n, all_, different, F.col(name))
        now = now.withColumns(mixed).drop("context", "count", "followers", "accepted", "rejected", "accepted_kinds", "rejected_kinds", f"c{k}")
    scores = now.groupBy("address").agg(((F.sum(F.log("bad")) - F.sum(F.log("good"))) / F.count("*")).alias(out))
    scores = scores.withColumnRenamed("address", address)
    return rows.join(scores, address, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def train(urls: DataFrame) -> UrlModel:
    """``urls``: columns ``address`` and ``rejected`` (boolean), every row that a rule decides. Copies count as often as they are
    there; they are added up before anything else."""
    small_batches(urls.sparkSession, 10_000)
    part = F.pmod(F.xxhash64("address"), F.lit(CALIBRATION_PART))
    each = urls.groupBy("address").agg(F.count(F.when(F.col("rejected"), 1)).alias("bad"), F.count(F.when(~F.col("rejected"), 1)).alias("good"))
    each = written(each.withColumn("aside", part == 0), "urls")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, owner = _characters(batch.column("address").to_pylist())
            keys, at = np.unique(cells, return_inverse=True)
            learnt = ~np.array(batch.column("aside").to_pylist(), bool)
            sums = []
            for side in ("good", "bad"):
                n = batch.column(side).to_numpy()
                sums += [np.bincount(at.ravel(), weights=np.tile((n * use)[owner], ORDERS), minlength=len(keys)).astype(np.int64) for use in (np.ones(len(n), np.int64), learnt)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, *sums)], ["cell", "accepted", "accepted_learnt", "rejected", "rejected_learnt"])

    names = ("accepted", "accepted_learnt", "rejected", "rejected_learnt")
    cells = each.select("address", "good", "bad", "aside").mapInArrow(count, "cell bigint, " + ", ".join(f"{n} bigint" for n in names))
    cells = written(cells.groupBy("cell").agg(*(F.sum(n).alias(n) for n in names)), "cells")
    if cells.count() <= MOST_CELLS:
        got = cells.toArrow().sort_by("cell")
        key = got["cell"].to_numpy()
        made = {n: Counts(key, got[n].to_numpy().astype(np.float64)) for n in names}
        model, other = UrlModel(made["accepted"], made["rejected"]), UrlModel(made["accepted_learnt"], made["rejected_learnt"])
    else:
        model = UrlModel(None, None, cells.select("cell", "accepted", "rejected"))
        other = UrlModel(None, None, cells.select("cell", F.col("accepted_learnt").alias("accepted"), F.col("rejected_learnt").alias("rejected")))
    scored = other.differences(each.where("aside"), "address", "x")
    bins = scored.groupBy(F.least(F.greatest(F.round(F.col("x") / BIN), F.lit(-BINS // 2)), F.lit(BINS // 2)).alias("bin")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    forget(each, *([cells] if model.table is None else []))
    x, good, bad = (bins[c].to_numpy().astype(np.float64) for c in ("bin", "good", "bad"))
    if good.sum() and bad.sum():
        slope, offset = platt(np.tile(x * BIN, 2), np.repeat([0.0, 1.0], len(x)), np.concatenate((good, bad)))
        if slope > 0:
            return UrlModel(model.accepted, model.rejected, model.table, slope, offset)
    return model


def filter_urls(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", block_from: float = BLOCK_FROM) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row; score is the method's probability of block, also where a rule decides.

    Null urls and those without ``://`` have empty host and path; the models judge them as an empty address, by the offset
    alone. A score of exactly ``block_from`` is allowed. Repeated rows and null ids: a row each. Very long urls are judged
    whole. Empty table: no row. Where the ruled URLs are all of one verdict, or none, the curve is the plain logistic one.
    Other columns, whatever their names, are not read.
    """
    small_batches(pages.sparkSession, 2048)
    parts = pages.select(F.col(quoted(page_id)).alias("page_id"), F.col(quoted(url)).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    ruled = parts.withColumns({"host": host, "path": path, "address": F.concat(host, _host_and_rest(F.col("url"))[1])}).drop("url")
    ruled = ruled.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    model = train(ruled.where("hit IS NOT NULL").select("address", (F.col("hit.verdict") == "block").alias("rejected")))
    scored = model.differences(ruled, "address", "x").withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(model.slope * F.col("x") + model.offset, F.lit(40.0)), F.lit(-40.0)))))
    told = F.coalesce(F.col("hit.verdict"), F.when(F.col("score") > block_from, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), told.alias("verdict"), "score")
