"""The registered queries of this package, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import oracles
from lexforge.llm._shared import shared_path, table
from lexforge.llm.byte_bpe import encoded_digests
from lexforge.llm.embedding_dedup import near_duplicates
from lexforge.llm.hard_negatives import mine_hard_negatives
from lexforge.llm.jaccard_join import jaccard_components
from lexforge.llm.language_id import predict_language
from lexforge.llm.private_data import KINDS, find_private, spans_text
from lexforge.llm.quality_classifier import score_quality
from lexforge.llm.quality_rules import judge
from lexforge.llm.source_mixture import mixture_report
from lexforge.llm.suffix_dedup import remove_repeats
from lexforge.llm.toxicity import score_toxicity
from lexforge.llm.warc import assemble, read_records, resolve, write_warc
from lexforge.llm.whitening import whiten


def op1_cover_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    removed = F.expr("aggregate(spans, 0L, (s, x) -> s + x.to - x.from)")
    return remove_repeats(docs).select(
        "doc_id",
        (F.octet_length("kept") + removed).alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    return encoded_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return resolve(assemble(read_records(spark, path, payloads=False)))


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.concat("base", "extra")).alias("spans"))


def op10_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_report(table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_cover_tree_dedup, op2_toxicity, op3_host_rules, op4_suffix_array_dedup, op5_jaccard_join, op6_quality_classifier, op7_byte_bpe, op8_warc_transactions, op9_private_data, op10_source_mixture, op11_language_id, op12_hard_negatives, op13_embedding_whitening)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
