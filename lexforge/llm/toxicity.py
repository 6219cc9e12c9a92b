"""Toxicity from the nearest labelled examples by TF-IDF cosine.

A bounded sample of labelled documents is the index. Its terms are words, and beginnings of words,
that labelled-toxic examples have surely more often than others; inverse document frequencies of
these terms are counted over all documents. (Over all words, nearness is of topics: the README has
figures.) The index is inverted: a term's postings lie by example and fall into blocks of examples,
and each block has its largest weight. A query adds these up to bound its cosine with every block,
opens blocks from the largest bound on, reads in them the postings of its own terms only, and stops
where the bound is below the k-th best cosine, so its neighbours are exact. Votes weighted by
nearness are calibrated by a logistic curve fitted to the examples, each left out of its own
neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.words import texts, word_numbers

#: Bounds of the index: examples of each label, about, by a hash of their id. Their texts bound its terms.
TOXIC_EXAMPLES = 3000
OTHER_EXAMPLES = 5000
NEIGHBOURS = 15
BLOCK = 64
HEAD = 5


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


@dataclass
class Index:
    terms: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    rows: np.ndarray  # postings by term and then by example: example and weight
    weights: np.ndarray
    starts: np.ndarray  # by term and block: where its postings begin
    largest: np.ndarray  # by term and block: the largest weight
    block: int  # examples in a block
    slope: float = 1.0
    shift: float = 0.0
    alone: float = 0.0

    def query(self, at: np.ndarray, weight: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples and their cosines, exactly; ``at`` and ``weight`` are a unit vector."""
        bounds = weight @ self.largest[at]
        best, cosines = np.zeros(0, dtype=np.int64), np.zeros(0)
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or len(best) == NEIGHBOURS and bounds[b] < cosines[-1] - 1e-12:
                break
            some = np.flatnonzero(self.largest[at, b])
            first = self.starts[at[some], b]
            n = self.starts[at[some], b + 1] - first
            postings = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
            dots = np.bincount(self.rows[postings] - b * self.block, weights=self.weights[postings] * np.repeat(weight[some], n), minlength=self.block)
            found = np.flatnonzero(dots > 0)
            found = found[found + b * self.block != skip]
            best, cosines = np.concatenate([best, found + b * self.block]), np.concatenate([cosines, dots[found]])
            keep = np.lexsort((best, -cosines))[:NEIGHBOURS]
            best, cosines = best[keep], cosines[keep]
        return best, cosines

    def vote(self, best: np.ndarray, cosines: np.ndarray) -> float:
        near = 1 / (1.05 - np.minimum(cosines, 1))
        return float((near * (2 * self.toxic[best] - 1)).sum() / (near.sum() + 1))

    def score(self, best: np.ndarray, cosines: np.ndarray) -> float:
        if not len(best):
            return self.alone
        return float(1 / (1 + np.exp(-(self.slope * self.vote(best, cosines) + self.shift))))


def _counts(column: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms of each text and how often they occur."""
    for _, counts, found in word_numbers(column, HEAD):
        at = 0
        for n in counts.tolist():
            yield np.unique(found[at : at + n], return_counts=True)
            at += n


def _selected(column: list[bytes | None], terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which of some terms, ascending, each text has, and how often."""
    for _, counts, found in word_numbers(column, HEAD):
        at = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
        hit = np.flatnonzero(terms[at] == found) if len(terms) else np.zeros(0, dtype=np.int64)
        edge = np.searchsorted(hit, np.cumsum(counts))
        last = 0
        for e in edge.tolist():
            yield np.unique(at[hit[last:e]], return_counts=True) if e > last else (hit[:0], hit[:0])
            last = e


def _vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weight = (1 + np.log(n)) * idf[at] if len(at) else np.zeros(0)
    size = np.sqrt((weight * weight).sum())
    return at, weight / size if size else weight


def build_index(documents: DataFrame, labels: DataFrame) -> Index:
    """Fit on about TOXIC_EXAMPLES and OTHER_EXAMPLES labelled rows, which the driver gets."""
    labelled = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).where(~held_out())
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    bound = {True: TOXIC_EXAMPLES, False: OTHER_EXAMPLES}
    share = {t: min(1.0, bound[t] / n) for t, n in sizes.items()}
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.when(F.col("toxic"), share.get(True, 0.0)).otherwise(share.get(False, 0.0)) * (1 << 30)
    # of rows that repeat an id the one of smallest text counts, so that few rows come to the driver and reruns agree
    some = documents.select("doc_id", "text").join(F.broadcast(labelled.where(pick)), "doc_id")
    some = some.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    ids, toxic = some["doc_id"].to_numpy(np.int64), some["toxic"].to_numpy(bool)
    column = [t.encode() if t else None for t in some["text"]]
    bags = [x for x, _ in _counts(column)]
    terms = _terms(bags, toxic)
    idf = _idf(documents, terms)
    order = np.zeros(0, dtype=np.int64)
    vectors = [_vector(at, n, idf) for at, n in _selected(column, terms)]
    # examples whose heaviest terms agree stand together, which keeps the largest weights of most blocks small
    top = np.array([at[w.argmax()] if len(at) else len(terms) for at, w in vectors], dtype=np.int64)
    order = np.lexsort((ids, top))
    order = order[top[order] < len(terms)]
    blocks = -(-len(order) // BLOCK)
    rows = np.concatenate([np.full(len(vectors[o][0]), i) for i, o in enumerate(order)] or [order])
    columns = np.concatenate([vectors[o][0] for o in order] or [order])
    weights = np.concatenate([vectors[o][1] for o in order] or [np.zeros(0)])
    largest = np.zeros((len(terms) + 1, blocks))
    np.maximum.at(largest, (columns, rows // BLOCK), weights)
    by = np.lexsort((rows, columns))
    rows, columns, weights = rows[by], columns[by], weights[by]
    edges = np.arange(len(terms) + 1)[:, None] * blocks + np.arange(blocks + 1)
    starts = np.searchsorted(columns * blocks + rows // BLOCK, edges) if blocks else np.zeros((len(terms) + 1, 1), dtype=np.int64)
    index = Index(terms, idf, ids[order], toxic[order].astype(np.float64), rows, weights, starts, largest, BLOCK)
    _calibrate(index, [vectors[o] for o in order], order, toxic, share)
    return index


def _terms(bags: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Terms of at least three examples whose log odds for toxic are surely above 0."""
    each, place = np.unique(np.concatenate([*bags, np.zeros(0, np.uint64)]), return_inverse=True)
    owner = np.repeat(toxic, [len(b) for b in bags])
    a, b = np.bincount(place, weights=owner, minlength=len(each)), np.bincount(place, weights=~owner, minlength=len(each))
    n, m = toxic.sum() + 1.0, (~toxic).sum() + 1.0
    odds = np.log((a + 0.5) / n) - np.log((b + 0.5) / m)
    sure = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    return each[(a + b >= 3) & (odds > 1) & (sure > 1.64)]


def _idf(documents: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Over all documents: a row for each term comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms) + 1, dtype=np.int64)
        for batch in batches:
            total[-1] += len(batch)
            for at, _ in _selected(texts(batch.column(0)), terms):
                total[at] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["term", "n"])

    rows = documents.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(terms) + 1)
    out[rows["term"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return np.log((1 + out[-1]) / (1 + out[:-1])) + 1


def _calibrate(index: Index, vectors: list[tuple[np.ndarray, np.ndarray]], order: np.ndarray, toxic: np.ndarray, share: dict[bool, float]) -> None:
    """Weighted so that the sample's shares of labels are those of all labelled rows."""
    weight = np.array([1 / share.get(bool(t), 1.0) for t in toxic])
    rest = np.setdiff1d(np.arange(len(toxic)), order)
    index.alone = float(((weight * toxic)[rest].sum() + 0.5) / (weight[rest].sum() + 10))
    votes = []
    for i, v in enumerate(vectors):
        best, cosines = index.query(*v, skip=i)
        votes.append(index.vote(best, cosines) if len(best) else -1.0)
    x, y, w = np.array(votes), index.toxic, weight[order]
    a, b = 2.0, 0.0
    for _ in range(50):  # Newton, with a little shrinking towards a slope of 2
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(w * (p - y) * x).sum() + (a - 2), (w * (p - y)).sum() + 0.1 * b])
        c = w * p * (1 - p)
        h = np.array([[(c * x * x).sum() + 1, (c * x).sum()], [(c * x).sum(), c.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    index.slope, index.shift = float(a), float(b)


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, and evidence: its nearest examples.

    A null or empty text, and one without any indexed term, gets the rate of such examples. Labels
    that are null or of no document teach nothing; of several labels of a document the highest
    counts. Without toxic labels all scores are near 0. Rows may repeat (of an example's texts the
    smallest is learned from); other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = docs.sparkSession.sparkContext.broadcast(build_index(docs, labels))
    evidence = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know = index.value
        for batch in batches:
            scores, near = [], []
            for at, n in _selected(texts(batch.column("text")), know.terms):
                best, cosines = know.query(*_vector(at, n, know.idf)) if len(at) else (at, at)
                scores.append(know.score(best, cosines))
                near.append([{"doc_id": int(know.ids[b]), "cosine": float(c), "toxic": int(know.toxic[b])} for b, c in zip(best[:3], cosines[:3], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(near, pa.list_(evidence))], ["doc_id", "score", "evidence"])

    found = docs.mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
