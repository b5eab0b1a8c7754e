"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import learn_part, table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_blocks import token_blocks

    return token_blocks(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_forest import scan, seed_findings, train

    return scan(table(spark, sf_dir, "documents"), train(seed_findings(spark)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_lr import quality, train

    docs = table(spark, sf_dir, "documents")
    return quality(docs, train(docs, table(spark, sf_dir, "labels")))


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pfair_mix import pfair_slots

    return pfair_slots(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity_mil import score_documents, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), where=learn_part("doc_id", 3) != 1)
    scored = score_documents(docs, model, threshold=0.7)
    return scored.select("doc_id", (learn_part("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "offending")


def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_crf import predict_languages, train

    docs = table(spark, sf_dir, "documents")
    told = predict_languages(docs, train(docs, where=learn_part("doc_id", 5) != 0))
    return told.select("doc_id", (learn_part("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_markov import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_slices import hex16, simhash_components

    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", hex16().alias("fingerprint"), "component_id")


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .template_decontam import contaminated_pairs

    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_blocks, op2_secret_scan, op3_quality_rules, op4_pfair_mix, op5_toxicity, op6_language_crf, op7_url_filters, op8_token_counts, op9_simhash_components, op10_template_decontamination)}


def oracle_sql() -> dict[str, str]:
    from . import pfair_mix

    return {"op4_pfair_mix": pfair_mix.SQL}
