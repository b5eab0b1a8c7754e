"""Mixing sources to target weights by proportionate-fair scheduling.

Each source is a task with a whole-number weight w of all weights' sum W, both without their common divisor. Its block j
may run from floor(j * W / w) on and must have run by ceil((j + 1) * W / w); in each slot the released block with the
earliest deadline runs. The shares w / W add up to one, so this keeps every deadline, and after any number of slots a
source has had less than one block more or less than its share, as long as it has blocks. The schedule repeats after
exactly W slots, so one period, a table of W rows, places every block of any number by arithmetic, without any
drift. A source that has run out leaves its slots empty; the others keep theirs.

Documents are numbered within their source in the order of a hash of their ids, so the blocks are a random draw. The
numbers come from counts by source and leading hash digits, and from ranks inside these small groups: no source is ever
one task's, and no id that many rows share. All of it is DataFrame operations; the driver holds one row a source and
one period.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted

#: Slots that a period of tempered shares has, about; more where there are many sources.
RESOLUTION = 1024
#: Slots of a period at most, which bounds the table that every worker is sent.
MOST_SLOTS = 1 << 20
BLOCK_DOCS = 16
#: Hexadecimal digits of the hash that the counts are kept by.
DIGITS = 3
#: Rows of one id that are numbered together; an id that more rows share, and one in HOT of all, is split.
SAME_ID = 4096
HOT = 10_000


def reduced(weights: dict) -> dict:
    """Positive whole-number weights without their common divisor: slots of a period for each source."""
    if any(w != int(w) or w <= 0 for w in weights.values()):
        raise ValueError("weights are positive whole numbers")
    g = math.gcd(*map(int, weights.values()))
    out = {s: int(w) // g for s, w in weights.items()}
    if sum(out.values()) > MOST_SLOTS:
        raise ValueError(f"the weights repeat after {sum(out.values())} slots; give some that repeat after {MOST_SLOTS} at most")
    return out


def period(q: dict) -> list[tuple]:
    """(source, block of the period, slot), by earliest deadline first among the released; ties by name."""
    slots = sum(q.values())
    waiting = [(0, s, 0) for s in q]
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * slots // q[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j, t))
        if j + 1 < q[s]:
            heapq.heappush(waiting, ((j + 1) * slots // q[s], s, j + 1))
    return out


def tempered(counts: dict, resolution: int = RESOLUTION) -> dict:
    """Target weights between the sources' own shares and equal ones: square roots of their counts, as whole numbers whose sum
    is about ``resolution``, or four times the number of sources if that is more; one at least."""
    roots = {s: math.isqrt(n * 1_000_000) for s, n in counts.items()}
    total, slots = sum(roots.values()), max(resolution, 4 * len(counts))
    return {s: max(1, (2 * r * slots + total) // (2 * total)) for s, r in roots.items()}


def _name(source: str) -> Column:
    """A source's name without nulls: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def source_counts(docs: DataFrame, source: str = "source", most: int = MOST_SLOTS // 4) -> dict:
    """Documents of each source. A period has a slot for each, so more sources than ``most`` are refused."""
    rows = docs.groupBy(_name(source).alias("s")).count().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sources")
    return {r["s"]: r["count"] for r in rows}


def pfair_slots(docs: DataFrame, weights: dict | None = None, doc_id: str = "doc_id", source: str = "source", block_docs: int = BLOCK_DOCS, names: tuple[str, str, str] = ("mix_block", "mix_slot", "mix_place")) -> DataFrame:
    """The documents with their block of the source, the block's slot, and the place within the block, in columns ``names``.

    ``weights``: whole numbers by source (None as a name: rows without one); sources it doesn't name are refused. None:
    tempered shares. Ordering by slot and place is the mix. Null ids hash as the empty text; equal ids follow each other
    by the hash of the row, and identical rows are interchangeable; an id that very many rows share comes after the others of its
    hash digits. Texts are carried along, however long. Empty input: no row. Input columns named as in ``names`` are
    replaced; no other name can clash.
    """
    names = list(names)
    docs = docs.drop(*names)
    s, h, b, sub, i, j, t, q, before, here = fresh(docs, "_source", "_hash", "_digits", "_split", "_number", "_j", "_slot", "_q", "_before", "_here")
    counts = source_counts(docs, source)
    if weights is None:
        weights = tempered(counts) if counts else {}
    else:
        weights = {"n" if k is None else f"s{k}": w for k, w in weights.items()}
        if missing := set(counts) - set(weights):
            raise ValueError(f"no weight for {sorted(missing)[:5]}")
    spark, total = docs.sparkSession, sum(counts.values())
    share = reduced(weights) if weights else {}
    slots = sum(share.values())
    plan = spark.createDataFrame([(k, x, at, share[k]) for k, x, at in period(share)], f"{s} string, {j} bigint, {t} bigint, {q} bigint")
    key = F.md5(F.coalesce(F.col(quoted(doc_id)).cast("string"), F.lit("")).cast("binary"))
    plain = [F.col(quoted(c)) for c, kind in docs.dtypes if "map" not in kind and "variant" not in kind]
    # ids that many rows share: at most HOT of them, whatever the table holds
    shared = docs.select(key.alias(h)).groupBy(h).agg(F.count("*").alias(here)).where((F.col(here) > SAME_ID) & (F.col(here) * HOT >= total))
    part = F.pmod(F.xxhash64(*plain, F.spark_partition_id()), F.ceil(F.col(here) / SAME_ID)) + 1
    keyed = docs.select("*", _name(source).alias(s), key.alias(h)).join(F.broadcast(shared), h, "left")
    keyed = keyed.withColumns({b: F.substring(h, 1, DIGITS), sub: F.coalesce(part, F.lit(0))}).drop(here)
    small = keyed.groupBy(s, b, sub).agg(F.count("*").alias(here))
    # 16 ** DIGITS rows a source, and one for each SAME_ID rows of a shared id
    first = small.select(s, b, sub, (F.sum(here).over(Window.partitionBy(s).orderBy(b, sub)) - F.col(here)).alias(before))
    rank = F.row_number().over(Window.partitionBy(s, b, sub).orderBy(h, F.col(quoted(doc_id)), F.xxhash64(*plain)))
    placed = keyed.join(first, [s, b, sub]).withColumn(i, F.col(before) + rank - 1)
    placed = placed.withColumns({names[0]: F.floor(F.col(i) / block_docs), names[2]: F.col(i) % block_docs})
    shares = spark.createDataFrame(list(share.items()), f"{s} string, {q} bigint")
    placed = placed.join(F.broadcast(shares), s).withColumn(j, F.col(names[0]) % F.col(q)).join(F.broadcast(plan.drop(q)), [s, j])
    slot = F.floor(F.col(names[0]) / F.col(q)) * slots + F.col(t)
    return placed.withColumn(names[1], slot).select(*(F.col(quoted(c)) for c in (*docs.columns, *names)))


#: The same as ``pfair_slots`` with its defaults, for DuckDB: doc_id, source and the three columns.
SQL = f"""
WITH RECURSIVE counted AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rooted AS (SELECT source, CAST(floor(sqrt(CAST(n AS DOUBLE) * 1000000)) AS BIGINT) AS r FROM counted),
total AS (SELECT CAST(sum(r) AS BIGINT) AS total, greatest({RESOLUTION}, 4 * count(*)) AS slots FROM rooted),
weighted AS (SELECT source, greatest(1, (2 * r * slots + total) // (2 * total)) AS w FROM rooted, total),
divisors AS (SELECT max(g) AS g FROM range(1, (SELECT CAST(min(w) AS BIGINT) + 1 FROM weighted)) AS x(g) WHERE (SELECT sum(w % g) FROM weighted) = 0),
quota AS (SELECT source, CAST(w // g AS BIGINT) AS q, row_number() OVER (ORDER BY source) AS k FROM weighted, divisors),
period AS (SELECT CAST(sum(q) AS BIGINT) AS slots FROM quota),
tasks AS (SELECT list(q ORDER BY k) AS q, list(k ORDER BY k) AS ks FROM quota),
run(t, next, pick) AS (
  SELECT -1, [0 for x in q], CAST(0 AS BIGINT) FROM tasks
  UNION ALL
  SELECT t + 1, [next[i] + CASE WHEN i = chosen THEN 1 ELSE 0 END for i in ks], chosen
  FROM (SELECT r.t, r.next, tasks.ks, list_min([{{'d': -((-(r.next[i] + 1) * slots) // tasks.q[i]), 'i': i}} for i in tasks.ks if r.next[i] < tasks.q[i] AND (r.next[i] * slots) // tasks.q[i] <= r.t + 1]).i AS chosen
        FROM run r, tasks, period WHERE r.t + 1 < slots)),
placed_slots AS (SELECT t, pick, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM run WHERE t >= 0),
numbered AS (SELECT doc_id, d.source, q, k, row_number() OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS i FROM documents d JOIN quota USING (source)),
placed AS (SELECT *, i // {BLOCK_DOCS} AS mix_block, i % {BLOCK_DOCS} AS mix_place FROM numbered)
SELECT doc_id, source, CAST(mix_block AS BIGINT) AS mix_block, CAST((mix_block // q) * slots + t AS BIGINT) AS mix_slot, CAST(mix_place AS BIGINT) AS mix_place
FROM placed JOIN placed_slots ON pick = k AND j = mix_block % q, period
"""
