"""What the training-data operators share: inputs, the shared folder, Arrow batch sizes, hashing of words."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space that ends a word: space, tab, newline, vertical tab, form feed, carriage return.
WORD_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 128, size: str = "2m") -> None:
    """Arrow batches of whole texts: few rows and few bytes each, so that a worker holds a bounded share of a partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


_WRITTEN: set[str] = set()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir. Where it is unset, a local master gets
    a temporary folder; a cluster, whose executors would not see that, an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a table in the shared folder: a lost executor costs no recomputation beyond it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.discard(path)


def forget(*tables: DataFrame) -> None:
    """Removes written tables that no plan needs any more."""
    for t in tables:
        if path := getattr(t, "shared_path", None):
            _remove(t.sparkSession, path)


def clean_up(spark: SparkSession) -> None:
    """Removes all tables that this process has written to the shared folder; results that read them must be done with."""
    for path in list(_WRITTEN):
        _remove(spark, path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame doesn't have, in any case."""
    there = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in there:
            n += "_"
        out.append(n)
    return out


#: A key with at least one in so many of all rows is hot; there are at most so many.
HOT = 10_000


def join_hot(rows: DataFrame, facts: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, which has one row a key and in ``count`` how many rows that key has at least.

    Keys with at least one in HOT of all ``total`` rows are HOT at most: they are broadcast. The others are shuffled, and none
    of them is large.
    """
    is_hot = F.col("count") * HOT >= total
    hot = F.broadcast(facts.where(is_hot))
    rest = rows.join(F.broadcast(facts.where(is_hot).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(facts.where(~is_hot), key, how))


def learn_part(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the split that the held-out rows are told by. A null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def flat_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, each followed by a newline, and where each text starts (one entry more)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.zeros(0, np.uint8), starts


#: Whether a byte is such white space.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[ord(c) for c in WORD_SPACE]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a span that are hashed eight at a time for all spans at once; longer ones go to XXH64 one by one.
_SHORT = 512
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, each by its bytes alone: eight bytes and a scrambling at a time, the length first."""
    size = ends - starts
    h = mix64(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= _SHORT))
    at, left, now = starts[live], size[live], h[live]
    while len(live):
        now = mix64((now ^ (eight[at] & _MASKS[np.minimum(left, 8)])) + np.uint64(0x9E3779B97F4A7C15))
        h[live] = now
        more = left > 8
        live, at, left, now = live[more], at[more] + 8, left[more] - 8, now[more]
    long = np.flatnonzero(size > _SHORT)
    if len(long):
        import xxhash

        for k in long.tolist():
            h[k] = xxhash.xxh64_intdigest(memoryview(data[starts[k] : ends[k]]))
    return h


#: Bytes of text that a model is fitted on at most, and of one of its texts.
LABELLED_BYTES = 64 << 20
LABELLED_TEXT_BYTES = 1 << 20


def sampled_labels(
    labels: DataFrame, docs: DataFrame, label: str, most: int, where: Column | None = None, doc_id: str = "doc_id", text: str = "text",
    most_bytes: int = LABELLED_BYTES, text_bytes: int = LABELLED_TEXT_BYTES,
) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents, one row an id, chosen by the hash of their ids, texts whole.

    Labels without id or value don't count; of several for one id the largest holds, of several texts of one id the one with
    the smallest hash. Texts of more than ``text_bytes`` are not drawn, nor what comes after ``most_bytes`` in the order of
    the hash: rows and bytes are bounded whatever the tables hold. Null texts count as empty.
    """
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    rows = rows.where(where) if where is not None else rows
    chosen = rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    texts = texts.where(F.octet_length("text") <= text_bytes).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    so_far = F.sum(F.octet_length("text").cast("bigint")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over ``most`` rows
    bounded = one.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes)
    return bounded.select("doc_id", "text", "label").repartition(docs.sparkSession.sparkContext.defaultParallelism)


def release() -> None:
    """Gives the memory that a fit has freed back to the system, where the allocator can: the driver lives on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Adam:
    """Gradient steps with soft thresholding (L1) after each."""

    def __init__(self, shape, rate: float, l1: float = 0.0):
        self.m, self.v, self.t, self.rate, self.l1 = np.zeros(shape), np.zeros(shape), 0, rate, l1

    def step(self, x: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        size = self.rate / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)
        x = x - size * self.m / (1 - 0.9**self.t)
        return np.sign(x) * np.maximum(np.abs(x) - size * self.l1, 0) if self.l1 else x


def lbfgs(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Minimises a smooth convex function, which returns its value and gradient."""
    value, grad = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, kept = -grad, []
        for s, y, r in reversed(past):
            kept.append(r * (s @ d))
            d = d - kept[-1] * y
        if past:
            s, y, r = past[-1]
            d = d / (r * (y @ y))
        for (s, y, r), a in zip(past, reversed(kept)):
            d = d + (a - r * (y @ d)) * s
        slope, step = grad @ d, 1.0 if past else 1.0 / max(1e-12, float(np.abs(grad).max()))
        if slope >= -1e-14:
            break
        for _ in range(30):
            new, new_grad = loss(x + step * d)
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * d, new_grad - grad
        if s @ y > 1e-16:
            past = [*past[-memory + 1 :], (s, y, 1 / (s @ y))]
        x, done = x + s, value - new < 1e-7 * max(1.0, abs(value))
        value, grad = new, new_grad
        if done:
            break
    return x


def platt(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and offset of the logistic curve that makes scores into probabilities; Newton steps with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * scores + b)
        w = weights * (p * (1 - p) + 1e-9)
        g = np.array([(weights * (p - labels) * scores).sum() + 0.01 * (a - 1), (weights * (p - labels)).sum() + 0.01 * b])
        h = np.array([[(w * scores * scores).sum() + 0.01, (w * scores).sum()], [(w * scores).sum(), w.sum() + 0.01]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 2.0 / max(1e-9, np.abs(d).max()))
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-6:
            break
    return float(a), float(b)
