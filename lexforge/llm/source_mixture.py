"""Mixing sources to target weights by blocks of words.

The texts of a source, in a pseudorandom order, are one stream of words that is cut into blocks of
a fixed length. Each source gets a number of slots, whose blocks make up its target. The slots of a
source fall on output shards by a multinomial draw, so a shard holds multinomial counts of the
sources, given that each source's counts add up to its target exactly. (Draws of each shard by
itself would miss the targets of small sources and exceed the limit of full ones.) The k-th slot of a source takes block p(k), where p is a pseudorandom permutation of the
source's blocks (a Feistel network, with another key for each pass through them), and the blocks
are joined by source and index. A block is used at most once a pass, so no document is taken more
often than the passes allow.

Only sums over sources reach the driver, one row at a time. The planner takes what a few sources'
rows expand to for small, so the joins are told to merge rather than to broadcast it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm._shared import durable, unused

BLOCK_WORDS = 64
SHARD_BLOCKS = 1 << 15
TASK_SLOTS = 1 << 16
MOST_TASKS = 20_000
BUCKET_DOCS = 20_000
#: Documents whose passes a task holds at once.
CUT_ROWS = 256
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 20_240_601


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


@dataclass
class Mixture:
    """rows: the documents' own columns with size, source_size, target, start. pieces: (source, start,
    block, low, high): words of a document, counted from 0, that lie in a block. slots: (source,
    shard, place, pass, block), the output in order of shard and place."""

    rows: DataFrame
    pieces: DataFrame
    slots: DataFrame

    def taken(self) -> DataFrame:
        """(source, start, taken): words that the mixture takes of a document, repeats counted."""
        uses = self.slots.groupBy("source", "block").agg(F.count("*").alias("uses"))
        return self.pieces.join(uses.hint("merge"), ["source", "block"]).groupBy("source", "start").agg(F.sum(F.col("uses") * (F.col("high") - F.col("low"))).alias("taken"))

    def uses(self) -> DataFrame:
        """(source, start, low, high, uses) of each piece that is taken at all."""
        uses = self.slots.groupBy("source", "block").agg(F.count("*").alias("uses"))
        return self.pieces.join(uses.hint("merge"), ["source", "block"]).drop("block")

    def blocks(self) -> DataFrame:
        """(shard, place, source, block, start, low, high): the output's words, as pieces of documents."""
        return self.pieces.join(self.slots.hint("merge"), ["source", "block"]).select("shard", "place", "source", "block", "start", "low", "high")


def mix(
    documents: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> Mixture:
    """Plan a mixture. Sources by code point, null last, weigh ``weights``, repeating.

    Together the targets are ``share`` of all words; a target is at most ``most`` times its
    source's words, and the excess goes to the others by weight. A null or blank text has no
    words. Rows may repeat; each is a document of its own. An empty source has target 0.
    """
    docs = documents.select(
        F.col(id_col).cast("long").alias("id"),
        F.concat(F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce(F.col(source_col).cast("string"), F.lit(""))).alias("source"),
        word_count(text_col).alias("size"),
        F.xxhash64(text_col).alias("hash"),
    )
    # short rows: files as many as their own size needs, not as the texts are dealt
    docs = durable(docs.hint("rebalance"))
    sources = durable(_targets(docs, weights, share, most, block_words))
    rows = _streams(docs, sources)
    ends = F.col("start") + F.col("size")
    block = F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((ends - 1) / block_words))).alias("block")
    pieces = rows.where("size > 0").select("source", "start", ends.alias("end"), block)
    pieces = pieces.select(
        "source",
        "start",
        "block",
        (F.greatest("start", F.col("block") * block_words) - F.col("start")).alias("low"),
        (F.least("end", (F.col("block") + 1) * block_words) - F.col("start")).alias("high"),
    )
    return Mixture(rows, pieces, _slots(sources, shard_blocks, seed))


def _targets(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, block_words: int) -> DataFrame:
    """(source, source_size, target, n_blocks, n_slots): the level at which weights and limits meet."""
    rank = F.row_number().over(Window.orderBy("source")) - 1
    each = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = durable(each.withColumn("rank", rank)).withColumns(
        {"weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")), "limit": F.col("source_size") * most}
    )
    total = each.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        open_ = F.col("weight") * level < F.col("limit")
        row = each.agg(F.sum(F.when(~open_, F.col("limit"))).alias("at"), F.sum(F.when(open_, F.col("weight"))).alias("w"), F.sum(F.when(~open_, 1).otherwise(0)).alias("n")).first()
        if not row["w"] or row["n"] == full:
            level = level if row["w"] else float("inf")
            break
        level, full = (share * total - (row["at"] or 0.0)) / row["w"], row["n"]
    target = F.least("limit", F.col("weight") * level) if level != float("inf") else F.col("limit")
    each = each.withColumn("target", target.cast("double")).withColumn("n_blocks", F.ceil(F.col("source_size") / block_words))
    part = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    slots = F.least(F.floor(F.col("n_blocks") * most), F.round(F.col("n_blocks") * part)).cast("long")
    return each.select("source", "rank", "source_size", "target", "n_blocks", slots.alias("n_slots"))


def _streams(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """The documents with the place of their first word in their source's stream.

    A source is ordered by pseudorandom buckets of documents; places are sums over its buckets'
    totals and sums inside a bucket, so that no task sees all of a source.
    """
    buckets = max(1, -(-docs.count() // BUCKET_DOCS))
    dealt = docs.withColumn("bucket", F.pmod(F.xxhash64("id", "hash"), F.lit(buckets)))
    totals = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("head"))
    inside = Window.partitionBy("source", "bucket").orderBy("id", "hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(heads, ["source", "bucket"]).join(sources.select("source", "source_size", "target"), "source")
    return placed.select("id", "hash", "source", "size", "source_size", "target", (F.col("head") + F.col("own")).alias("start"))


def permuted(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``k``: a Feistel network, walked until it is in range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    steps = np.random.default_rng([key & 0xFFFFFFFF, key >> 32 & 0xFFFFFFFF]).integers(1, 1 << 62, 4).astype(np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for s in steps:
            f = (b + s) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
            a, b = b, a ^ (f >> np.uint64(32) & mask)
        return a << np.uint64(half) | b

    x = once(np.asarray(k, dtype=np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def _slots(sources: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    total = sources.agg(F.sum("n_slots")).first()[0] or 0
    shards = max(1, -(-total // shard_blocks))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                counts = np.random.default_rng([seed, row.rank]).multinomial(row.n_slots, np.full(shards, 1 / shards))
                first = np.cumsum(counts) - counts
                yield pd.DataFrame({"source": row.source, "rank": row.rank, "n_blocks": row.n_blocks, "shard": np.arange(shards), "first": first, "n": counts})[counts > 0]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                k = np.arange(row["first"], row["first"] + row["n"])
                turn = k // row["n_blocks"]
                block = np.empty(len(k), dtype=np.int64)
                for p in np.unique(turn):
                    some = turn == p
                    block[some] = permuted(k[some] % row["n_blocks"], row["n_blocks"], (seed << 40) + (row["rank"] << 8) + int(p))
                place = permuted(k % (1 << 40), 1 << 40, seed + row["rank"] + 1)  # slots of a shard stand in the order of this
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["source"]] * len(k)), pa.array(np.full(len(k), row["shard"])), pa.array(place), pa.array(turn), pa.array(block)],
                    ["source", "shard", "place", "pass", "block"],
                )

    drawn = sources.where("n_slots > 0").select("source", "rank", "n_blocks", "n_slots").mapInPandas(draw, "source string, rank int, n_blocks long, shard long, first long, n long")
    # short rows that grow: a number of tasks by what they make, which adaptive execution leaves as it is
    tasks = min(MOST_TASKS, 1 + int(total) // TASK_SLOTS)
    return drawn.repartition(tasks, F.col("source"), F.col("shard")).mapInArrow(fill, "source string, shard long, place long, `pass` long, block long")


def mixture_report(documents: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken."""
    plan = mix(documents, **options)
    return plan.rows.join(plan.taken().hint("merge"), ["source", "start"], "left").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken")
    )


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mixture as documents: a row for each pass in which any of a document's words are taken.

    A row's text is the document's text if all words are taken in that pass, else the stretches of
    it that are. All columns stay; ``n_chars``, where there is one, follows the text.
    """
    plan = mix(documents, **options)
    names = documents.columns
    # a piece used twice is in both passes
    lists = plan.uses().groupBy("source", "start").agg(F.collect_list(F.struct("low", "high", "uses")).alias("pieces"))
    order = Window.partitionBy("id", "hash").orderBy("start")
    # an empty document begins where the next one does
    keyed = plan.rows.where("size > 0").join(lists.hint("merge"), ["source", "start"]).select("id", "hash", "size", "pieces", F.row_number().over(order).alias("nth"))
    key, digest, place, length, listed = unused(names, "_id", "_hash", "_nth", "_size", "_pieces")
    again = Window.partitionBy(key, digest).orderBy(key)
    own = documents.withColumns({key: F.col("doc_id").cast("long"), digest: F.xxhash64("text")})
    own = own.withColumn(place, F.row_number().over(again))
    keyed = keyed.select(*[F.col(c).alias(f"{c}{'_' * 40}") for c in keyed.columns])
    side = lambda c: F.col(f"{c}{'_' * 40}")
    joined = own.join(keyed.hint("merge"), F.col(key).eqNullSafe(side("id")) & (F.col(digest) == side("hash")) & (F.col(place) == side("nth")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), CUT_ROWS):
                yield _passes(batch.slice(at, CUT_ROWS), names, length, listed)

    return joined.select(*names, side("size").alias(length), side("pieces").alias(listed)).mapInArrow(cut, documents.schema)


def _passes(batch: pa.RecordBatch, names: list[str], length: str, listed: str) -> pa.RecordBatch:
    """A row for each pass in which words of a document are taken, in the columns ``names``."""
    pieces = batch.column(listed)
    ends = np.cumsum(pc.list_value_length(pieces).to_numpy()).tolist()
    each = pieces.flatten()
    flat = list(zip(*(each.field(x).to_pylist() for x in ("low", "high", "uses")), strict=True))
    rows, out, first = [], [], 0
    for i, (text, size, end) in enumerate(zip(batch.column("text").to_pylist(), batch.column(length).to_pylist(), ends, strict=True)):
        some, first = sorted(flat[first:end]), end
        for turn in range(1, 1 + max(uses for _, _, uses in some)):
            runs: list[list[int]] = []
            for low, high, uses in some:
                if uses < turn:
                    continue
                if runs and runs[-1][1] == low:
                    runs[-1][1] = high
                else:
                    runs.append([low, high])
            rows.append(i)
            out.append(text if runs == [[0, size]] else _stretches(text, runs))
    put = {"text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())}
    take = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays([put[n] if n in put else batch.column(n).take(take) for n in names], names)


_BLANKS = np.array([32, *range(9, 14)])


def _stretches(text: str, runs: list[list[int]]) -> str:
    data = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    solid = np.concatenate([[False], ~np.isin(data, _BLANKS), [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[::2], edge[1::2]
    return " ".join(text[start[x] : end[y - 1]] for x, y in runs)
