"""The corpus pipeline: each stage applies one operator of the training-data package to what is left.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes each result as Parquet and reads it again as the next
one's documents.
"""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm._shared import durable, shared_path, table, unused
from lexforge.llm.byte_bpe import encode
from lexforge.llm.jaccard_join import jaccard_components
from lexforge.llm.private_data import redact
from lexforge.llm.quality_classifier import accepted
from lexforge.llm.source_mixture import mixed_documents

#: Near-duplicate documents share this percentage of their distinct five-word shingles.
NEAR_WORDS, NEAR_PERCENT = 5, 80


#: So many ids that stand for several texts are sent to all tasks at most.
FEW_IDS = 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, each row judged by itself.

    So rows without an id, and rows that repeat one, go or stay by their own text, language and
    source; null or empty texts are scored like any other. All columns and repeats stay as they are.
    """
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents that near-duplicate links connect: the one of smallest id.

    Rows that repeat an id and its text are one document, and one of them stays; rows that repeat an
    id with other texts are documents of their own. Rows without an id are one document if they have
    the same text, and stay only where no row of their group has an id. Texts without words link
    with nothing: one row stays for each id, and all rows that have no id either.
    """
    nothing = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    row = unused(docs.columns, "_row")[0]
    keyed = _numbered(docs.where(~nothing), row)
    found = durable(jaccard_components(keyed, NEAR_WORDS, NEAR_PERCENT, row).distinct())
    large = found.groupBy("component_id").agg(F.count("*").alias("c")).where("c > 1").select("component_id")
    members = found.join(large, "component_id").join(keyed.select(row, "doc_id").distinct(), row).withColumnRenamed(row, "_row")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("m"))
    dropped = members.join(first, "component_id").where("_row <> m._row").select(F.col("_row").alias(row))
    single = keyed.dropDuplicates([row]).join(dropped, row, "left_anti")
    return single.select(*docs.columns).union(docs.where(nothing))


def _numbered(docs: DataFrame, row: str) -> DataFrame:
    """The rows with a number: the id where all its rows have one text, else a hash of id and text.

    A hash has 64 bits, so that two documents share a number with a chance of about n * n / 2**65.
    """
    text = F.coalesce("text", F.lit(""))
    mark = unused([*docs.columns, row], "_several")[0]
    own = F.xxhash64(F.lit("row"), F.col("doc_id").isNull(), "doc_id", text)
    several = durable(docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64(text)).alias("a"), F.max(F.xxhash64(text)).alias("b")).where("a <> b").select("doc_id", F.lit(True).alias(mark)))
    n = several.count()
    if not n:
        return docs.withColumn(row, F.coalesce(F.col("doc_id").cast("long"), own))
    marked = docs.join(F.broadcast(several) if n <= FEW_IDS else several, "doc_id", "left")
    number = F.when(F.col("doc_id").isNull() | F.col(mark), own).otherwise(F.col("doc_id").cast("long"))
    return marked.select(*docs.columns, number.alias(row))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind, and ``n_chars`` of what is left.

    Every row is redacted by its own text, also without an id or with one that repeats. A null text
    stays null, with null ``n_chars``; an empty one stays.
    """
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture of sources takes of the documents, repeats as further rows.

    Rows that repeat are documents of their own. Texts without a word, null or not, have nothing to
    take and go; so do documents that no drawn block touches. A null source is a source, the last one.
    """
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, as little-endian unsigned 32-bit numbers, and their count.

    A null text has no tokens. Columns that are called ``ids`` or ``n_tokens`` give way to these.
    """
    ranks = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    there = encode(docs, ranks, public_tokenizers.PATTERN)
    return there.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("PII", private_data), ("source mixture", mixture), ("byte-level BPE", tokens)]

#: SQL cannot express the fitted classifier or the pseudorandom mixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
