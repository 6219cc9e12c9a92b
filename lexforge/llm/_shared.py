"""Helpers that several operators of this package use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges for which a round of components has a further task.
ROUND_EDGES = 1 << 16
#: A word is a run of anything but the space and U+0009 to U+000D.
BLANK = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``. A local session that
    names none gets a temporary one; on a cluster that is an error, as executors share no local folder.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: under that of the checkpoints."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir", "")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def unused(names: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has."""
    taken = {n.lower() for n in names}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges`` has two long columns, ``a`` and ``b``; loops and repeats are allowed. Returns
    ``node`` and ``root`` (the smallest node of its component) for every node other than the
    roots. Alternating large-star and small-star steps: each is a grouped minimum, which is
    combined before the shuffle, and an equi-join, which adaptive execution splits where one node
    has very many edges. The edges are checkpointed after each round, in as many partitions as their
    number needs, however many the shuffles have.
    """
    now = durable(_pairs(edges))
    seen = _state(now)
    while True:
        tasks = 1 + seen[0] // ROUND_EDGES
        now = durable(_small_star(_large_star(now.coalesce(tasks))).coalesce(tasks))
        state = _state(now)
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def _pairs(edges: DataFrame) -> DataFrame:
    return (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    out = both.where("b > a").join(least, "a")
    return _pairs(out.select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    out = edges.join(least, "a")
    return _pairs(out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))
