"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 16 or more characters of keys and digests inside a word, ended by an assignment sign, or the value,
of six characters on, that is assigned to a telling name. The forest sees its length, its transitions between kinds of
characters, how much of it a dictionary covers, the path it was found under and the words around it, and is trained on
labelled findings. The path is the last one named in the 50 words before the candidate, else a column of the document.
The dictionary is a table of words; unless one is given it is made of the documents themselves. Everything is DataFrame
operations; the forest is Spark's own.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, join_hot, written

RUN = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
WORD_GAP = r"[ \t\n\x0B\f\r]+"
SECRET_FROM = 0.5
TREES, DEPTH, SEED = 32, 8, 11
#: Documents that a word of the dictionary must be in, and letters of it and of the parts that are looked up.
LEAST_DOCUMENTS = 3
PART = "[A-Z]?[a-z]{3,}|[A-Z]{4,}"
DICTIONARY_WORD = "(?<![A-Za-z0-9+/_=-])[A-Za-z]?[a-z]{3,23}(?![A-Za-z0-9+/_=-])"
#: Words before a candidate that a path is looked for in.
PATH_WORDS = 50

_NAMES = "secret|token|passw|pwd|passphrase|api.?key|access.?key|auth|credential|private.?key|bearer"
#: A telling name, an assignment sign, and the value up to the end of its word.
ASSIGNED = f"(?i)({_NAMES})[A-Za-z0-9_.-]*[\"'`]?[ ]?(=>|:=|=|:)[ ]?[\"'`]?([^ \"'`,;()<>]{{6,}})[\"'`,;)]*\\z"
_TELLING = f"(?i)({_NAMES})"
_HARMLESS = r"(?i)(sha\d*|hash|commit|md5|checksum|digest|uuid|guid|revision|etag|fingerprint|build|version|ref|trace|request)"
_PLACEHOLDER = r"(?i)(example|sample|dummy|fake|mock|placeholder|your|changeme|xxxx|redacted|required|optional|getenv|environ|config|none|null)"
_QUIET_PATH = r"(?i)(^|[/_.\-])(tests?|examples?|samples?|docs?|fixtures?|mocks?)([/_.\-]|$)"
_PATH = r"^[\"'(]?[A-Za-z0-9_.\-]*/[A-Za-z0-9_./\-]*\.[A-Za-z0-9]{1,5}[\"'),:;]?$"

#: Columns of a finding: the candidate, its word, two words before and one after it, the path, all strings.
FINDING = ("candidate", "word", "before2", "before1", "after", "path")


def features() -> dict[str, Column]:
    """Numbers of a finding, which also has ``covered``, its letters in dictionary words; null strings count as empty."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in FINDING}
    c, n = text["candidate"], F.greatest(F.length("candidate"), F.lit(1)).cast("double")
    share = lambda pattern: F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0)) / n
    has = lambda column, pattern: F.coalesce(column.rlike(pattern), F.lit(False)).cast("double")
    around = F.concat_ws(" ", text["before2"], text["before1"], F.call_function("substring_index", text["word"], c, F.lit(1)))
    return {
        "length": F.length(c).cast("double"),
        "digits": share("[0-9]"), "uppers": share("[A-Z]"), "marks": share(r"[+/_=\-]"), "others": share(r"[^A-Za-z0-9+/_=\-]"), "vowels": share("(?i)[aeiou]"),
        "hex": has(c, "^[0-9a-fA-F]+$"), "digits_only": has(c, "^[0-9]+$"), "letters_only": has(c, "^[A-Za-z]+$"), "upper_digits": has(c, "^[A-Z0-9]+$"),
        "letter_digit": share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"), "case": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "vowel_consonant": share("(?i)[aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou])"), "doubled": share(r"(.)(?=\1)"),
        "different": F.size(F.array_distinct(F.split(c, ""))) / n,
        "dictionary": F.least(F.coalesce(F.col("covered"), F.lit(0)) / n, F.lit(1.0)),
        "slashes": F.regexp_count(text["word"], F.lit("/")).cast("double"), "dashes": F.regexp_count(c, F.lit("-")).cast("double"), "underlines": F.regexp_count(c, F.lit("_")).cast("double"),
        "uuid": has(c, "^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"),
        "quiet_path": has(text["path"], _QUIET_PATH),
        "telling": has(around, _TELLING), "harmless": has(around, _HARMLESS), "placeholder": has(F.concat_ws(" ", around, c, text["after"]), _PLACEHOLDER),
        "assigned": has(around, "(=>|:=|=|:)[ ]?[\"'`]?$"), "quoted": has(text["word"], "[\"'`]"),
    }


def dictionary(docs: DataFrame, text: str = "text", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(word): the lower-case words of four letters or more that stand alone in at least ``least`` documents."""
    words = F.transform(F.regexp_extract_all(F.col(text).cast("string"), F.lit(DICTIONARY_WORD), F.lit(0)), F.lower)
    each = docs.select(F.explode(F.array_distinct(words)).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word")


#: Examples by rule: value, text before it, label. Names in angle brackets stand for drawn strings.
_KINDS = [
    *((v, "<said> <name><sign>", 1) for v in ("<hex>", "<md5>", "<long>", "<long>", "<prefix><long>", "<capitals>", "<weak>", "<weak>", "<json>")),
    ("<long>", "<path> <name><sign>", 1), ("<long>", "<said> <bearer>", 1), ("<prefix><long>", "<said> ", 1), ("<capitals>", "<said> <key>", 1), ("<json>", "<said> <session>", 1),
    *((v, "<said> <harmless>", 0) for v in ("<hex>", "<md5>", "<hex>")),
    *((v, "<said> ", 0) for v in ("<uuid>", "<slug>", "<snake>", "<camel>", "<digits>", "-" * 24, "<a>/<b>/<c>/<d>")),
    ("<uuid>", "<said> <number>", 0), ("<digits>", "<said> <number>", 0),
    *((v, "<said> <name><sign>", 0) for v in ("x" * 20, "your-api-key-here-<id>", "example_<long>", "changeme123", "<a>", "<snake>", "<slug>", "<call>", "required")),
    ("<hex>", "in <quiet> the <name><sign>", 0), ("<long>", "in <quiet>: <name><sign>", 0),
]


def _examples(spark: SparkSession, n: int) -> DataFrame:
    """doc_id, text, value, label: small documents with a candidate of each kind, by rule, the same each time."""
    seed = F.concat(F.lit("finding"), F.col("id")).cast("binary")
    words = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda x: F.element_at(F.split(F.lit(" ".join(_WORDS)), " "), (F.pmod(F.xxhash64("id", x), F.lit(len(_WORDS))) + 1).cast("int")))
    drawn = F.translate(F.base64(F.unhex(F.concat(F.sha2(seed, 512), F.sha2(seed, 256)))), "=+/", "aB3")
    rows = written(spark.range(0, n, 1, 2).select("id", F.sha1(seed).alias("hex"), F.md5(seed).alias("md5"), drawn.alias("drawn"), words.alias("w")), "drawn")
    pick = lambda *x: F.element_at(F.split(F.lit("|".join(x)), "[|]"), (F.pmod(F.xxhash64("id", F.lit(x[0])), F.lit(len(x))) + 1).cast("int"))
    w = lambda k: F.get("w", F.lit(k))
    part = lambda a, k: F.substring("drawn", a, k)
    drawn = {
        "said": F.concat_ws(" ", w(0), w(1), w(2)), "a": w(3), "b": w(4), "c": w(5), "d": w(6), "id": F.col("id").cast("string"), "hex": F.col("hex"), "md5": F.col("md5"),
        "long": F.col("drawn").substr(F.lit(1), 20 + F.pmod(F.xxhash64("id", F.lit(7)), F.lit(44)).cast("int")),
        "prefix": F.concat(F.lower(F.regexp_replace(part(70, 4), "[0-9]", "k")), pick("_", "-", "_live_", "_test_")),
        "capitals": F.upper(part(3, 20)), "weak": F.concat(F.initcap(w(7)), F.pmod("id", F.lit(977)).cast("string"), pick("!", "#", "$x", "%", "-9", "_Q"), part(9, 4)),
        "json": F.translate(F.base64(F.concat(F.lit('{"'), w(8), F.lit('":"'), part(1, 12), F.lit('","'), w(9), F.lit('":1}')).cast("binary")), "=+/", "aB3"),
        "uuid": F.concat_ws("-", *(F.substring("hex", a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))),
        "slug": F.concat_ws("-", w(3), w(4), w(5), w(6)), "snake": F.concat_ws("_", w(7), w(8), w(9)), "camel": F.concat(w(7), F.initcap(w(8)), F.initcap(w(9))),
        "digits": F.lpad((F.col("id") * 2654435761 % 10**16).cast("string"), 16, "4"), "call": F.concat(pick("get_", "load_", "read_", "os.environ."), w(3)),
        "path": F.concat(w(10), F.lit("/"), w(11), pick(".py", ".yaml", ".env", ".js")), "quiet": F.concat(pick("tests/", "src/tests/", "docs/", "examples/", "fixtures/"), w(11), pick(".py", ".yaml", ".md")),
        "name": pick("token", "secret", "api_key", "password", "auth_token", "access-key", "client_secret", "TOKEN", "apikey", "db_password", "private_key", "credentials"),
        "sign": pick(" = ", ": ", "=", ' = "', '="', ': "', " := "), "bearer": pick("Authorization: Bearer ", "Bearer ", "bearer:"), "key": pick("access_key_id = ", "aws_access_key=", "key id: "),
        "session": pick("cookie: session=", "jwt ", "Authorization: "), "number": pick("id: ", "request=", "number: ", "phone="),
        "harmless": pick("commit ", "sha1: ", "md5=", "checksum = ", "revision ", "digest: ", "etag=", "hash ", "trace: ", "build "),
    }
    line = F.split(F.element_at(F.split(F.lit("\n".join("\t".join(map(str, k)) for k in _KINDS)), "\n"), (F.pmod("id", F.lit(len(_KINDS))) + 1).cast("int")), "\t")
    made = rows.select("id", line.alias("line"), F.map_from_arrays(F.array(*map(F.lit, drawn)), F.array(*drawn.values())).alias("drawn"))
    fill = lambda c: F.array_join(F.transform(F.regexp_extract_all(c, F.lit("<[a-z0-9]+>|[^<>]+"), F.lit(0)), lambda p: F.coalesce(F.try_element_at("drawn", F.regexp_extract(p, "^<(.*)>$", 1)), p)), "")
    made = made.select(F.col("id").alias("doc_id"), fill(F.get("line", F.lit(0))).alias("value"), fill(F.get("line", F.lit(1))).alias("before"), F.get("line", F.lit(2)).cast("int").alias("label"))
    quote = F.when(F.col("before").rlike('"$'), '"').otherwise("")
    return made.select("doc_id", F.concat("before", "value", quote, F.lit(" and more")).alias("text"), "value", "label")


#: Words that the examples are made of.
_WORDS = [
    "server", "table", "window", "number", "order", "public", "garden", "river", "simple", "market", "letter", "morning", "paper", "winter", "engine", "castle",
    "branch", "signal", "planet", "silver", "bridge", "record", "travel", "common", "yellow", "member", "object", "master", "profile", "session",
]


def seed_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Labelled findings made by rule, found in ``n`` small documents as the scan finds them."""
    made = written(_examples(spark, n), "examples")
    words = spark.createDataFrame([(w,) for w in _WORDS], "word string")
    found = covered(candidates(made, path=None), words)
    out = written(found.join(made.select("doc_id", "value", "label"), "doc_id").where("candidate = value").select("doc_id", *FINDING, "covered", "label"), "findings")
    forget(made)
    return out


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    """Fits the forest; rows without a label don't count."""
    f = features()
    rows = findings.where("label IS NOT NULL").select(*(c.alias(k) for k, c in f.items()), F.col("label").cast("double").alias("label"))
    rows = VectorAssembler(inputCols=list(f), outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED).fit(rows)


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """doc_id, word_no (from 0), part (from 0, of the word) and the finding's strings, one row a candidate."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"), (F.col(path).cast("string") if path else F.lit("")).alias("source"))
    rows = rows.where(F.col("t").rlike(RUN) | F.col("t").rlike(_TELLING)).withColumn("w", F.split("t", WORD_GAP))
    at = lambda i: F.when((i >= 0) & (i < F.size("w")), F.get("w", i)).otherwise("")

    def finding(w: Column, i: Column) -> Column:
        value = F.regexp_extract(F.concat_ws(" ", at(i - 2), at(i - 1), w), ASSIGNED, 3)
        return F.struct(i.alias("word_no"), w.alias("word"), at(i - 2).alias("before2"), at(i - 1).alias("before1"), at(i + 1).alias("after"), value.alias("value"))

    def assigned(w: Column, i: Column) -> Column:
        sign = [f(c) for c in ("=", ":", ">") for f in (w.contains, at(i - 1).endswith)]  # without one the pattern can't fit
        return reduce(or_, sign) & F.concat_ws(" ", at(i - 2), at(i - 1), w).rlike(ASSIGNED)

    numbered = F.transform("w", lambda w, i: F.when(((F.length(w) >= 16) & w.rlike(RUN)) | assigned(w, i), finding(w, i)))
    found = rows.select("doc_id", "source", "w", F.explode(F.filter(numbered, lambda x: x.isNotNull())).alias("f")).select("doc_id", "source", "w", "f.*")
    runs = F.regexp_extract_all("word", F.lit(f"({RUN})"), 1)
    each = F.when(F.col("value") == "", runs).otherwise(F.concat(F.array("value"), F.filter(runs, lambda r: F.instr(F.col("value"), r) == 0)))
    start = F.greatest(F.col("word_no") - PATH_WORDS, F.lit(0))
    named = F.filter(F.slice("w", start + 1, F.col("word_no") - start), lambda x: x.rlike(_PATH))
    found = found.withColumns({"each": each, "path": F.coalesce(F.try_element_at(named, F.lit(-1)), "source", F.lit(""))})
    return found.select("doc_id", "word_no", "word", "before2", "before1", "after", "path", F.posexplode("each").alias("part", "candidate"))


def covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with ``covered``: how many of each candidate's characters are in parts that are words of the table (word)."""
    found = written(found.withColumn("finding", F.monotonically_increasing_id()), "candidates")
    parts = found.select("finding", F.explode(F.regexp_extract_all("candidate", F.lit(PART), F.lit(0))).alias("part")).select("finding", F.lower("part").alias("word"), F.length("part").alias("n"))
    total = max(1, found.count())
    known = parts.groupBy("word").agg(F.count("*").alias("count")).join(words.select("word").distinct(), "word")
    sums = join_hot(parts, known, "word", total).groupBy("finding").agg(F.sum("n").alias("covered"))
    return found.join(sums, "finding", "left").drop("finding")


def scan(docs: DataFrame, model: RandomForestClassificationModel, doc_id: str = "doc_id", text: str = "text", path: str | None = "source", secret_from: float = SECRET_FROM, words: DataFrame | None = None) -> DataFrame:
    """doc_id, word_no, part, candidate, score, is_secret of every candidate. ``words``: the dictionary (word), or None.

    Null and empty texts have none. Null ids and repeated rows: rows each. A null path counts as empty. A score of exactly
    ``secret_from`` is a secret. Very long texts are split into words whole. Empty input: no row. Other columns, whatever
    their names, are not read.
    """
    f = features()
    rows = covered(candidates(docs, doc_id, text, path), dictionary(docs, text) if words is None else words)
    rows = rows.select("doc_id", "word_no", "part", "candidate", F.struct(*(c.alias(k) for k, c in f.items())).alias("f")).select("doc_id", "word_no", "part", "candidate", "f.*")
    scored = model.transform(VectorAssembler(inputCols=list(f), outputCol="features").transform(rows))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "word_no", "part", "candidate", score.alias("score")).withColumn("is_secret", F.col("score") >= secret_from)
