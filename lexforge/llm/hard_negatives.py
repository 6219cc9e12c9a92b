"""Hard negatives by distributed radix selection.

A window belongs to an anchor: a range of integer scores, of rows with the anchor's label or of
others, from which the first ``k`` rows are wanted. Each task counts its rows' scores in a histogram
of ``BUCKETS`` equal buckets for each window, and the sums tell which bucket has the kth score. That
bucket is the next range, until it has no more rows than a few over ``k``, or one score. A last scan
gathers only rows that qualify, the first ``k`` of each window in each task, so ties stay few.

Selection runs twice: for each anchor's positives over all scores, then for each anchor and positive
for negatives in the range of scores that the positive's allows.

Anchors are a stated query set against all rows. They are taken in blocks by hash, of a checked size;
all that the driver or a broadcast ever holds are the anchors, windows and histograms of one block.
Vectors are whole numbers, packed once in a checkpointed table which all scans read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm._shared import durable, shared_path

#: Bound of the anchors of a block.
BLOCK = 2048
BUCKETS = 64
#: A window is refined no more once so many rows over those wanted are left.
SPARE = 16
SCALE = 256
#: Rows whose scores are held at once.
_ROWS = 4096
_EXACT = 1 << 53
_LOW = -(1 << 62)
_GROUP = 64


@dataclass
class Anchors:
    """Anchors of one block, by ascending length of vectors: ids, labels, and a matrix for each length."""

    ids: np.ndarray
    labels: np.ndarray
    parts: dict[int, tuple[int, np.ndarray]] = field(default_factory=dict)  # where they start, and the vectors


@dataclass
class Windows:
    """Ranges of scores, by ascending anchor: ``low`` to ``high``, and how many rows above ``high`` are taken already."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    above: np.ndarray
    floor: np.ndarray  # rows of this score or a higher one, up to top, are gathered
    top: np.ndarray
    done: np.ndarray


def packed_vectors(embeddings: DataFrame, relabel_every: int = 7) -> DataFrame:
    """vec_id, label, n and x, the components floor(256 * c) as 64-bit integers, of all rows that take part.

    Where ``vec_id`` is divisible by ``relabel_every`` the label becomes (label + 1) % 10. Rows
    without an id, a label or a vector, or with a component that is null or not finite, take no
    part. A component so large that a score could leave 63 bits counts as the largest that cannot.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    odd = F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & ~F.coalesce(odd, F.lit(True)))
    label = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("e")
            ends = np.append(0, np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
            flat = np.floor(np.asarray(col.flatten(), dtype=np.float64) * SCALE)
            sizes = np.diff(ends)
            edge = np.floor(np.sqrt(float(1 << 61) / np.maximum(np.repeat(sizes, sizes), 1)))  # no inner product leaves 63 bits
            whole = np.clip(flat, -edge, edge).astype(np.int64)
            found = [whole[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(sizes), pa.array(found, pa.binary())], ["vec_id", "label", "n", "x"])

    return rows.select("vec_id", label.alias("label"), "e").mapInArrow(pack, "vec_id long, label long, n long, x binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows of one length: the length, ids, labels, vectors."""
    for whole in batches:
        for at in range(0, len(whole), _ROWS):
            batch = whole.slice(at, _ROWS)
            sizes = batch.column("n").to_numpy(zero_copy_only=False)
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
            raw = batch.column("x").to_pylist()
            for n in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == n)
                yield n, ids[some], labels[some], np.frombuffer(b"".join(raw[i] for i in some), np.int64).reshape(len(some), n)


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where none can leave 53 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1]
    if most < _EXACT:
        return (a.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return a @ x.T


def _eligible(anchors: Anchors, n: int, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each anchor of vectors as long: its number and the rows' scores, ``_LOW`` for rows that its windows do not take."""
    if n not in anchors.parts:
        return
    first, vectors = anchors.parts[n]
    step = 256
    for at in range(0, len(vectors), step):
        a = np.arange(first + at, min(first + at + step, first + len(vectors)))
        scores = _scores(vectors[at : at + step], x)
        match = anchors.labels[a][:, None] == labels[None, :]
        out = ~match | (anchors.ids[a][:, None] == ids[None, :]) if same else match
        scores[out] = _LOW
        yield from zip(a.tolist(), scores, strict=True)


def _edges(windows: Windows, w: np.ndarray) -> np.ndarray:
    """The least score of each bucket of the windows, highest bucket first."""
    low, high = windows.low[w].astype(object), windows.high[w].astype(object)
    width = -((low - high - 1) // BUCKETS)  # rounded up
    steps = high[:, None] + 1 - width[:, None] * np.arange(1, BUCKETS + 1, dtype=object)[None, :]
    return np.maximum(steps, low[:, None]).astype(np.int64)


def _histograms(rows: DataFrame, anchors, windows: Windows, open_: np.ndarray, same: bool) -> np.ndarray:
    """How many rows each bucket of the open windows has, summed over all tasks."""
    context = rows.sparkSession.sparkContext
    edges = _edges(windows, open_)
    owner = windows.anchor[open_]
    first = np.searchsorted(owner, np.arange(len(anchors.value.ids) + 1))
    groups = -(-len(open_) // _GROUP)
    known = context.broadcast((edges, windows.high[open_], first))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, high, first = known.value
        counts = np.zeros((groups * _GROUP, BUCKETS), dtype=np.int64)
        for block in _read(batches):
            for a, scores in _eligible(anchors.value, *block, same):
                x, y = first[a], first[a + 1]
                if x == y:
                    continue
                scores = np.sort(scores)
                over = np.searchsorted(scores, high[x:y], side="right")  # rows up to the window's highest score
                reached = over[:, None] - np.searchsorted(scores, edges[x:y])
                counts[x:y] += np.diff(reached, axis=1, prepend=0)
        some = [g for g in range(groups) if counts[g * _GROUP : (g + 1) * _GROUP].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([counts[g * _GROUP : (g + 1) * _GROUP].tobytes() for g in some], pa.binary())], ["g", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, part in zip(batch.column("g").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                totals[g] = totals.get(g, 0) + np.frombuffer(part, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["g", "counts"])

    out = np.zeros((groups, _GROUP * BUCKETS), dtype=np.int64)
    for r in rows.select("vec_id", "label", "n", "x").mapInArrow(scan, "g long, counts binary").repartition("g").mapInArrow(add, "g long, counts binary").collect():
        out[r["g"]] = np.frombuffer(r["counts"], np.int64)
    known.unpersist()
    return out.reshape(-1, BUCKETS)[: len(open_)]


def _refine(windows: Windows, open_: np.ndarray, counts: np.ndarray, k: int) -> None:
    """Narrow each open window to the bucket that has its kth score."""
    edges = _edges(windows, open_)
    reached = np.cumsum(counts, axis=1) + windows.above[open_][:, None]
    enough = reached >= k
    at = np.where(enough.any(1), enough.argmax(1), BUCKETS - 1)
    pick = np.arange(len(open_))
    low = edges[pick, at]
    high = np.where(at > 0, edges[pick, np.maximum(at - 1, 0)] - 1, windows.high[open_])
    windows.floor[open_] = low
    windows.above[open_] = np.where(at > 0, reached[pick, np.maximum(at - 1, 0)], windows.above[open_])
    windows.done[open_] = ~enough.any(1) | (reached[pick, at] <= k + SPARE) | (low == high)
    windows.low[open_], windows.high[open_] = low, high


def _windows(anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> Windows:
    empty = low > high
    return Windows(anchor, low.copy(), high.copy(), np.zeros(len(anchor), dtype=np.int64), low.copy(), high.copy(), empty)


def _select(rows: DataFrame, anchors, windows: Windows, k: int, same: bool) -> DataFrame:
    """window, rank, vec_id, score: the first ``k`` rows of each window by falling score, then by id."""
    while len(open_ := np.flatnonzero(~windows.done)):
        _refine(windows, open_, _histograms(rows, anchors, windows, open_, same), k)
    first = np.searchsorted(windows.anchor, np.arange(len(anchors.value.ids) + 1))
    known = rows.sparkSession.sparkContext.broadcast((windows.floor, windows.top, first))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, top, first = known.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, ids, labels, x in _read(batches):
            for a, scores in _eligible(anchors.value, n, ids, labels, x, same):
                if first[a] == first[a + 1]:
                    continue
                some = np.flatnonzero(scores >= max(_LOW + 1, int(floor[first[a] : first[a + 1]].min())))
                for w in range(first[a], first[a + 1]) if len(some) else ():
                    fit = some[(scores[some] >= floor[w]) & (scores[some] <= top[w])]
                    if not len(fit):
                        continue
                    s, i = scores[fit], ids[fit]
                    if w in best:
                        s, i = np.append(s, best[w][0]), np.append(i, best[w][1])
                    order = np.lexsort((i, -s))[:k]
                    best[w] = s[order], i[order]
        got = list(best)
        size = [len(best[w][0]) for w in got]
        cols = [np.repeat(got, size), *(np.concatenate([best[w][j] for w in got]) if got else [] for j in (1, 0))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["window", "vec_id", "score"])

    found = rows.select("vec_id", "label", "n", "x").mapInArrow(gather, "window long, vec_id long, score long")
    order = Window.partitionBy("window").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(anchors: DataFrame, block: int) -> tuple[DataFrame, int]:
    """The anchors with the number of their block; no block has more than ``block``."""
    total = anchors.count()
    n = -(-total // block) if total <= block else -(-5 * total // (4 * block))
    while True:
        dealt = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(n)) if n > 1 else F.lit(0).cast("long"))
        if n <= 1 or dealt.groupBy("block").count().where(F.col("count") > block).isEmpty():
            return dealt, n
        n *= 2


def _taken(rows: DataFrame) -> Anchors:
    """One block of anchors, which the driver gets."""
    table = rows.select("vec_id", "label", "n", "x").toPandas().sort_values(["n", "vec_id", "label", "x"])
    out = Anchors(table["vec_id"].to_numpy(np.int64), table["label"].to_numpy(np.int64))
    sizes = table["n"].to_numpy(np.int64)
    for n in np.unique(sizes).tolist():
        some = np.flatnonzero(sizes == n)
        out.parts[n] = int(some[0]), np.frombuffer(b"".join(table["x"].iloc[i] for i in some), np.int64).reshape(len(some), n)
    return out


def _bounds(anchors: Anchors, norms: dict[int, float]) -> np.ndarray:
    """No score of an anchor is larger, or smaller than minus it: the product of lengths, rounded up."""
    out = np.zeros(len(anchors.ids), dtype=np.int64)
    for n, (first, x) in anchors.parts.items():
        own = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        out[first : first + len(x)] = np.minimum(own * norms.get(n, 0.0) * (1 + 1e-9) + 2, float(1 << 61)).astype(np.int64)
    return out


def mine_hard_negatives(embeddings: DataFrame, anchor_every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, relabel_every: int = 7, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows whose ``vec_id`` is divisible by ``anchor_every``. An anchor's positives are
    its first rows of another id and the same label by falling score, ties by smaller id; for each, its negatives are
    the first rows of other labels whose score times 100 is between ``low`` and ``high`` times the
    positive's. A positive of a score below 0 has none. ``packed_vectors`` says which rows take part;
    vectors of different length have no score with each other. Of rows that repeat, each counts,
    and repeated anchors are one. An empty table gives no rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = durable(packed_vectors(embeddings, relabel_every))
    norms = {r["n"]: float(r["q"]) ** 0.5 for r in _norms(rows).collect()}
    anchors, n = _blocks(durable(rows.where(F.col("vec_id") % anchor_every == 0).distinct()), block)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    path = shared_path(spark, "negatives")
    spark.createDataFrame([], schema).write.parquet(path)
    for b in range(n):
        taken = _taken(anchors.where(F.col("block") == b))
        known = spark.sparkContext.broadcast(taken)
        reach = _bounds(taken, norms)
        found = _select(rows, known, _windows(np.arange(len(reach)), -reach, reach), positives, True).toPandas().sort_values(["window", "rank"])
        owner, score = found["window"].to_numpy(np.int64), found["score"].to_numpy(np.int64)
        least, most = _range(score, low, high)
        chosen = _select(rows, known, _windows(owner, least, most), negatives, False)
        pairs = spark.sparkContext.broadcast((taken.ids[owner], found["vec_id"].to_numpy(np.int64), score))

        def name(batches: Iterator[pa.RecordBatch], pairs=pairs) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w = batch.column("window").to_numpy(zero_copy_only=False)
                a, p, s = (pa.array(x[w]) for x in pairs.value)
                yield pa.RecordBatch.from_arrays([a, p, batch.column("rank"), batch.column("vec_id"), s, batch.column("score")], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        chosen.mapInArrow(name, schema).write.mode("append").parquet(path)
        known.unpersist()
    return spark.read.schema(schema).parquet(path)


def _norms(rows: DataFrame) -> DataFrame:
    """The largest squared length of the vectors of each number of components."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, float] = {}
        for n, _, _, x in _read(batches):
            most[n] = max(most.get(n, 0.0), float((x.astype(np.float64) ** 2).sum(1).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int64()), pa.array(list(most.values()), pa.float64())], ["n", "q"])

    return rows.mapInArrow(scan, "n long, q double").groupBy("n").agg(F.max("q").alias("q"))


def _range(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest negative score s with low * p <= 100 * s <= high * p."""
    p = score.astype(object)
    return (-((-low * p) // 100)).astype(np.int64), ((high * p) // 100).astype(np.int64)
