"""Document quality by co-training of two views.

One view is the text's content: its words in hashed buckets and how much they repeat. The other is
the page's metadata: language, source, length and layout. Each view has a logistic model. Over some
rounds, each model labels all unlabelled documents, and every one that it is sure of trains the
other view's model. Both are then calibrated on labelled rows that neither was fitted to, and the
score is the mean of their calibrated log odds.

A round is a scan. Its tasks sum the gradient of the other view's loss over the documents that a
view is sure of, and a curvature for each weight, which together bound that loss from above for any
weights; the sums have the size of the weights. The driver fits the bounded sample of labelled rows
and these bounds; tasks make the sample's views, and the driver gets no texts. A last scan scores
all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.toxicity import held_out
from lexforge.llm.words import texts, word_numbers

#: Bound, about, of the sample by a hash of the id: rows with each label.
LABELLED = 3000
BUCKETS = 1 << 14
ROUNDS = 3
#: What a document that the other view labelled counts, beside 1 for a labelled row.
GIVEN_WEIGHT = 0.5
SURE = 0.95

_DENSE = 8
_FACTS = 12
_NAMES = 1 << 10
_SIZES = (BUCKETS + _DENSE, _NAMES + _FACTS)
_CHUNK = 1 << 11
#: Rows whose products are held at once.
_STEP = 512


def _layout(text: bytes) -> list[float]:
    """Shares of kinds of bytes and of lines."""
    data = np.frombuffer(text, np.uint8)
    n = max(len(data), 1)
    counts = np.bincount(data, minlength=256)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    lines = text.count(b"\n") + 1
    marks = counts[[33, 35, 36, 37, 38, 42, 60, 62, 124]].sum()
    return [counts[65:91].sum() / max(letters, 1), marks * 8 / n, counts[48:58].sum() * 8 / n, letters / n, np.log1p(n) / 10, np.log1p(lines) / 5, np.log1p(n / lines) / 10, 1.0]


@dataclass
class Rows:
    """Sparse rows: places and values one after another, and how many each row has."""

    place: np.ndarray
    value: np.ndarray
    count: np.ndarray

    @cached_property
    def steps(self) -> list[tuple[slice, slice]]:
        """Runs of rows, and where their places and values are."""
        end = np.concatenate([[0], np.cumsum(self.count)])
        cuts = [*range(0, len(self.count), _STEP), len(self.count)]
        return [(slice(a, b), slice(end[a], end[b])) for a, b in zip(cuts, cuts[1:], strict=False)]

    def owner(self, rows: slice) -> np.ndarray:
        count = self.count[rows]
        return np.repeat(np.arange(len(count)), count)

    def times(self, w: np.ndarray) -> np.ndarray:
        """For each row the sum of its values times what ``w`` has at their places."""
        out = np.zeros(len(self.count))
        for rows, at in self.steps:
            out[rows] = np.bincount(self.owner(rows), weights=self.value[at] * w[self.place[at]], minlength=rows.stop - rows.start)
        return out

    def sums(self, x: np.ndarray, size: int) -> np.ndarray:
        """For each place the sum of its values times what ``x`` has for their rows."""
        out = np.zeros(size)
        for rows, at in self.steps:
            out += np.bincount(self.place[at], weights=self.value[at] * x[rows][self.owner(rows)], minlength=size)
        return out

    def absolute(self) -> Rows:
        return Rows(self.place, np.abs(self.value), self.count)

    def some(self, rows: np.ndarray) -> Rows:
        start = np.cumsum(self.count) - self.count
        at = np.concatenate([np.arange(start[r], start[r] + self.count[r]) for r in rows] or [np.zeros(0, int)]).astype(np.int64)
        return Rows(self.place[at], self.value[at], self.count[rows])


def _rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
    none = np.zeros(0)
    return Rows(np.concatenate([*(p for p, _ in parts), none]).astype(np.int64), np.concatenate([*(v for _, v in parts), none]), np.array([len(p) for p, _ in parts], dtype=np.int64))


def _views(column: list[bytes | None], langs: list[str | None], sources: list[str | None]) -> tuple[Rows, Rows]:
    """The text view and the metadata view of some documents."""
    content, facts, i = [], [], 0
    for _, counts, found in word_numbers(column):
        at = 0
        for n in counts.tolist():
            words = found[at : at + n]
            at += n
            each, times = np.unique(words >> np.uint64(50), return_counts=True)
            pairs = len(np.unique(words[1:] * np.uint64(3) + words[:-1])) if n > 1 else 0
            dense = [len(each) / max(n, 1), (times.max() if n else 0) / max(n, 1), pairs / max(n - 1, 1), min(n, 50) / 50, np.log1p(n) / 10, float(n > 0), 1.0, 0.0]
            content.append((np.concatenate([each.astype(np.int64), BUCKETS + np.arange(_DENSE)]), np.concatenate([np.sqrt(times / max(n, 1)), dense])))
            text = column[i] or b""
            names = [xxhash.xxh3_64_intdigest(f"{k}={v}".encode()) % _NAMES for k, v in (("lang", langs[i]), ("source", sources[i]))]
            layout = _layout(text)
            facts.append((np.array([*names, *(_NAMES + np.arange(len(layout)))]), np.array([1.0, 1.0, *layout])))
            i += 1
    return _rows(content), _rows(facts)


@dataclass
class Bound:
    """A quadratic upper bound of a loss: its gradient and curvatures at some weights, and the weight of its rows."""

    at: np.ndarray
    gradient: np.ndarray
    curve: np.ndarray
    weight: float


def _fit(rows: Rows, y: np.ndarray, weight: np.ndarray, size: int, given: Bound | None = None, steps: int = 150) -> np.ndarray:
    """Logistic regression by Adam on whole batches, with a ridge, and with what bounds the loss of further rows."""
    w, m, v = np.zeros(size) if given is None else given.at.copy(), np.zeros(size), np.zeros(size)
    total = (weight.sum() + (given.weight if given else 0.0)) or 1.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(rows.times(w), -30, 30)))
        g = rows.sums(weight * (p - y), size)
        if given:
            g += given.gradient + given.curve * (w - given.at)
        g = g / total + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _taught(views: tuple[Rows, Rows], models: list[np.ndarray]) -> np.ndarray:
    """For each view its gradient, curvatures and number of rows, over the rows that the other view is sure of."""
    odds = [rows.times(w) for rows, w in zip(views, models, strict=True)]
    out = []
    for k, rows in enumerate(views):
        p = 1 / (1 + np.exp(-np.clip(odds[1 - k], -30, 30)))
        sure = (p >= SURE) | (1 - p >= SURE)
        mine = np.where(np.abs(odds[k]) < 1e-6, 1e-6, np.clip(odds[k], -30, 30))
        q = 1 / (1 + np.exp(-mine))
        # Jaakkola and Jordan: (q - 1/2) / x is the curvature of a parabola that is nowhere below the loss
        width = rows.absolute()
        slope, curve = sure * (q - (p >= 0.5)), sure * (q - 0.5) / mine * width.times(np.ones(_SIZES[k]))
        out += [rows.sums(slope, _SIZES[k]), width.sums(curve, _SIZES[k]), [sure.sum()]]
    return np.concatenate(out)


def _teach(docs: DataFrame, models: list[np.ndarray]) -> list[Bound]:
    """What each view learns from the other one in all of ``docs``: sums of fixed size come to the driver."""
    sizes = [n for size in _SIZES for n in (size, size, 1)]
    chunks = -(-sum(sizes) // _CHUNK)
    known = docs.sparkSession.sparkContext.broadcast(models)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(chunks * _CHUNK)
        for _, views in _viewed(batches):
            total[: sum(sizes)] += _taught(views, known.value)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(chunks)), pa.array([x.tobytes() for x in np.split(total, chunks)], pa.binary())], ["chunk", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, sums in zip(batch.column("chunk").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                totals[chunk] = totals.get(chunk, 0.0) + np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], ["chunk", "sums"])

    schema = "chunk long, sums binary"
    out = np.zeros((chunks, _CHUNK))
    for r in docs.select("text", "lang", "source").mapInArrow(scan, schema).repartition("chunk").mapInArrow(add, schema).collect():
        out[r["chunk"]] = np.frombuffer(r["sums"])
    parts = np.split(out.ravel()[: sum(sizes)], np.cumsum(sizes)[:-1])
    return [Bound(models[k], GIVEN_WEIGHT * parts[3 * k], GIVEN_WEIGHT * parts[3 * k + 1], GIVEN_WEIGHT * float(parts[3 * k + 2][0])) for k in (0, 1)]


def _platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        c = weight * p * (1 - p)
        g = np.array([(weight * (p - y) * x).sum() + (a - 1), (weight * (p - y)).sum() + 0.1 * b])
        h = np.array([[(c * x * x).sum() + 1, (c * x).sum()], [(c * x).sum(), c.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


@dataclass
class Model:
    weights: tuple[np.ndarray, np.ndarray]
    curves: list[tuple[float, float]]

    def score(self, views: tuple[Rows, Rows]) -> list[np.ndarray]:
        """The combined probability and those of the two views."""
        odds = [np.clip(a * rows.times(w) + b, -30, 30) for rows, w, (a, b) in zip(views, self.weights, self.curves, strict=True)]
        return [1 / (1 + np.exp(-x)) for x in ((odds[0] + odds[1]) / 2, *odds)]


def _sample(some: DataFrame) -> pa.Table:
    """doc_id, good, and the places and values of both views, by doc_id; the views are made in tasks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, views in _viewed(batches):
            columns = [batch.column("doc_id"), batch.column("good")]
            for rows in views:
                ends = pa.array(np.concatenate([[0], np.cumsum(rows.count)]), pa.int32())
                columns += [pa.ListArray.from_arrays(ends, pa.array(rows.place, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(rows.value))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "good", "place_0", "value_0", "place_1", "value_1"])

    schema = "doc_id long, good boolean, place_0 array<int>, value_0 array<double>, place_1 array<int>, value_1 array<double>"
    return some.mapInArrow(pack, schema).toArrow().sort_by("doc_id")


def _unpacked(some: pa.Table, k: int, rows: np.ndarray) -> Rows:
    place, value = (some[f"{x}_{k}"].take(pa.array(rows)).combine_chunks() for x in ("place", "value"))
    return Rows(place.flatten().to_numpy(), value.flatten().to_numpy(), pc.list_value_length(place).to_numpy().astype(np.int64))


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit on about LABELLED rows of each label, which the driver gets, and on all rows without one of those labels.

    Rows that are held out teach nothing; those without an id are unlabelled. Of labelled rows that
    repeat an id the one of smallest text, language and source counts.
    """
    labelled = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good")).where(~held_out())
    n = {r["good"]: r["count"] for r in labelled.groupBy("good").count().collect()}
    share = {k: min(1.0, LABELLED / v) for k, v in n.items()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    known = labelled.where(draw < F.when(F.col("good"), share.get(True, 0.0)).otherwise(share.get(False, 0.0)))
    docs = documents.select("doc_id", "text", "lang", "source")
    some = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "good").agg(F.min(F.struct("text", "lang", "source")).alias("d"))
    some = _sample(some.select("doc_id", "good", "d.*"))
    if not len(some):
        return Model((np.zeros(_SIZES[0]), np.zeros(_SIZES[1])), [(0.0, 30.0), (0.0, 30.0)])
    unlabelled = docs.where(F.col("doc_id").isNull() | ~held_out()).join(F.broadcast(known.select("doc_id")), "doc_id", "left_anti")
    y = some["good"].to_numpy().astype(np.float64)
    weight = np.array([1 / share[bool(g)] for g in y])
    apart = some["doc_id"].to_numpy() % 4 == 0
    fitted, tested = np.flatnonzero(~apart), np.flatnonzero(apart)
    if not len(tested) or not len(fitted):
        fitted = tested = np.arange(len(y))
    seen, rest = ([_unpacked(some, k, rows) for k in (0, 1)] for rows in (fitted, tested))
    del some
    models = [_fit(seen[k], y[fitted], weight[fitted], _SIZES[k]) for k in (0, 1)]
    for _ in range(ROUNDS):
        given = _teach(unlabelled, models)
        models = [_fit(seen[k], y[fitted], weight[fitted], _SIZES[k], given[k]) for k in (0, 1)]
    curves = [_platt(rest[k].times(models[k]), y[tested], weight[tested]) for k in (0, 1)]
    del seen, rest
    pa.default_memory_pool().release_unused()  # else the driver keeps the sample's memory for later queries
    return Model((models[0], models[1]), curves)


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, text_score and metadata_score.

    ``score`` is the probability of label 1, ``predicted`` is 1 if it is at least 0.5. Null texts,
    languages and sources are values of their own. Labels that are null or of no document teach
    nothing; of several labels of a document the lowest counts. Without labels all scores are
    near 1. Rows may repeat; other columns are ignored.
    """
    picked = [F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")]]
    docs = documents.select(*picked)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _scored(batches, model.value):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(s) for s in scores]], ["doc_id", "score", "text_score", "metadata_score"])

    found = docs.mapInArrow(run, "doc_id long, score double, text_score double, metadata_score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_score", "metadata_score")


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that ``score_quality`` predicts 1 for, each judged by itself whatever its id; columns stay."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _scored(batches, model.value):
            yield batch.filter(pa.array(scores[0] >= 0.5))

    return documents.mapInArrow(run, documents.schema)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch, views in _viewed(batches):
        yield batch, model.score(views)


def _viewed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple[Rows, Rows]]]:
    for whole in batches:
        for x in range(0, len(whole), 512):
            batch = whole.slice(x, 512)
            yield batch, _views(texts(batch.column("text")), batch.column("lang").to_pylist(), batch.column("source").to_pylist())
