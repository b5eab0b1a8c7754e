"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, benchmark leaks go, sources are mixed
to target weights, and the ids of what is left are written in blocks.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``. The mix is an order: the fourth stage returns its rows
sorted by it, Spark's writer numbers the files in that order, and the last stage takes the documents by file number and
row number, so the blocks hold them as mixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import pfair_mix, simhash_slices, template_decontam, token_blocks, toxicity_mil
from metricloom.llm.common import forget, fresh, learn_part, small_batches, table, written
from metricloom.llm.queries import tokenizer_path

END_ID = 2


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at or above the threshold go; null and empty texts stay, as do rows without an id. Repeated rows
    are judged alike, very long texts whole. Without labels nothing goes. Other columns, whatever their names, are kept."""
    model = toxicity_mil.train(docs, table(spark, sf_dir, "labels"), where=learn_part("doc_id", 3) != 1)
    small_batches(spark)
    return docs.where(toxicity_mil.score_column(model, spark) < toxicity_mil.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id stays, of repeated rows one; texts without words
    are copies of each other. A row without an id goes before one with. Other columns, whatever their names, are kept."""
    return simhash_slices.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers, units or names, go; null and empty texts stay. Repeated
    rows are judged alike, very long texts whole. Without a benchmark nothing goes. Other columns are kept."""
    return template_decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule. No column of theirs is touched; those of the schedule have other names."""
    names = fresh(docs, "mix_block", "mix_slot", "mix_place")
    return pfair_mix.pfair_slots(docs, names=tuple(names)).orderBy(*names[1:]).drop(*names)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the blocks, which hold the documents in the order of
    their files and rows; of a table that isn't files, in the order of doc_id. Null texts have the end id alone, repeated rows
    a row each, and an empty table no row; other columns are not read, and a very long text is a segment of its own."""
    if not docs.inputFiles():
        return token_blocks.token_blocks(docs, tokenizer_path(), END_ID)
    ordered = docs.select("doc_id", "text", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).alias("n"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    ordered = ordered.select("doc_id", "text", F.try_to_number("n", F.lit("9999999999")).cast("bigint").alias("n"), "file", "row")
    return token_blocks.token_blocks(ordered, tokenizer_path(), END_ID, order=["n", "file", "row"])


STAGES = [("toxicity", reject_toxic), ("near copies", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix_sources), ("token ids", write_tokens)]

#: Models and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    forget(docs)  # the blocks are written
    return out
