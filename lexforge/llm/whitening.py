"""Whitening of embeddings by a compensated covariance.

Components are whole numbers x. Their sums over all vectors are exact. A second scan centres every
vector on the mean and adds up its outer product in double-double: each value is a high and a low
double, products and sums are error-free transformations, and tasks send both parts, which are
merged in the same way. What comes to the driver is a matrix as large as vectors have components.
Its eigenvectors come from a tridiagonal divide and conquer. A third scan projects all vectors, and
two scans of the projections measure how far their covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm._shared import durable
from lexforge.llm.eigen import symmetric_eigen

SCALE, SHIFT = 1024, 100_000
#: Larger components than 2**52 in size after scaling count as that.
_LARGEST = float(1 << 52)
#: Rows whose products are held at once, and by how many tasks' parts the first merge is dealt.
_ROWS, _FAN = 512, 32

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """The sum of two doubles as the rounded one and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """The product of two doubles as the rounded one and its exact error."""
    p = a * b
    x, y = 134217729.0 * a, 134217729.0 * b
    ah, bh = x - (x - a), y - (y - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a: Pair, b: Pair) -> Pair:
    """The sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def multiply(a: Pair, b: Pair) -> Pair:
    """The product of two double-doubles."""
    p, e = two_product(a[0], b[0])
    return two_sum(p, e + (a[0] * b[1] + a[1] * b[0]))


def total(a: Pair) -> Pair:
    """The sum over the first axis, in halves."""
    high, low = a
    while len(high) > 1:
        m = len(high) // 2
        rest = (high[2 * m :], low[2 * m :])
        high, low = add((high[:m], low[:m]), (high[m : 2 * m], low[m : 2 * m]))
        high, low = np.concatenate([high, rest[0]]), np.concatenate([low, rest[1]])
    return (high[0], low[0]) if len(high) else (np.zeros(high.shape[1:]), np.zeros(high.shape[1:]))


def _split(x: Fraction) -> tuple[float, float]:
    high = float(x)
    return high, float(x - Fraction(high))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and e, the vector in doubles, of all rows whose vector is not null and has only finite entries."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    return rows.where(F.col("e").isNotNull() & (F.size("e") > 0) & F.coalesce(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _whole(e: np.ndarray) -> np.ndarray:
    """The vectors as whole numbers, in doubles that hold them exactly."""
    return np.clip(np.floor(e * SCALE), -_LARGEST, _LARGEST) + SHIFT


def _sizes_and_sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length of vectors, their number and the exact sums of their components."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("e").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(size).tolist():
                x = _whole(_matrix(batch.column("e").filter(pa.array(size == d)))).astype(np.int64)
                low, high = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array([d] * d), pa.array(range(d), pa.int64()), pa.array([len(x)] * d), pa.array(high), pa.array(low)], ["d", "i", "n", "high", "low"])

    sums = rows.select("e").mapInArrow(scan, "d long, i long, n long, high long, low long").groupBy("d", "i")
    sums = sums.agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in sums.orderBy("d", "i").collect():
        found.setdefault(r["d"], (r["n"], []))[1].append((int(r["high"]) << 32) + int(r["low"]))
    return found


def compensated_products(rows: DataFrame, column: str, mean: Pair, whole: bool = False) -> Pair:
    """Sums over all rows of the outer products of the vectors less ``mean``, in double-double.

    ``rows`` has arrays of doubles, as long as ``mean``, in ``column``; with ``whole`` they count as
    scaled whole numbers. Only the entries from the diagonal on are summed; the matrix is symmetric.
    """
    d = len(mean[0])
    schema = "i int, part int, high binary, low binary"

    def table(sums: list[Pair], part: int) -> pa.RecordBatch:
        cols = [pa.array(range(d), pa.int32()), pa.array([part] * d, pa.int32()), *(pa.array([s[k].tobytes() for s in sums], pa.binary()) for k in (0, 1))]
        return pa.RecordBatch.from_arrays(cols, ["i", "part", "high", "low"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[Pair] = [(np.zeros(d - i), np.zeros(d - i)) for i in range(d)]
        seen = 0
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                x = _matrix(batch.column(column).slice(at, _ROWS))
                x = _whole(x) if whole else x
                y = add((x, np.zeros_like(x)), (np.broadcast_to(-mean[0], x.shape), np.broadcast_to(-mean[1], x.shape)))
                seen += len(x)
                for i in range(d):
                    own = (y[0][:, i : i + 1], y[1][:, i : i + 1])
                    sums[i] = add(sums[i], total(multiply(own, (y[0][:, i:], y[1][:, i:]))))
        if seen:
            yield table(sums, TaskContext.get().partitionId() % _FAN)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Pair] = {}
        for batch in batches:
            for i, high, low in zip(*(batch.column(c).to_pylist() for c in ("i", "high", "low")), strict=True):
                pair = np.frombuffer(high), np.frombuffer(low)
                sums[i] = add(sums[i], pair) if i in sums else pair
        cols = [pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()), *(pa.array([s[k].tobytes() for s in sums.values()], pa.binary()) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays(cols, ["i", "part", "high", "low"])

    parts = rows.select(column).mapInArrow(scan, schema).repartition("i", "part").mapInArrow(merge, schema)
    out = np.zeros((d, d)), np.zeros((d, d))
    for r in parts.repartition("i").mapInArrow(merge, schema).collect():
        for k, name in enumerate(("high", "low")):
            out[k][r["i"], r["i"] :] = np.frombuffer(r[name])
    return tuple(m + np.triu(m, 1).T for m in out)


def _mean(rows: DataFrame, column: str, d: int, n: int) -> Pair:
    """The mean of arrays of doubles in double-double, by their products with 1."""
    ones = rows.select(F.concat(F.array(F.lit(1.0)), column).alias("v"))
    high, low = compensated_products(ones, "v", (np.zeros(d + 1), np.zeros(d + 1)))
    parts = [_split((Fraction(float(h)) + Fraction(float(x))) / n) for h, x in zip(high[0, 1:], low[0, 1:], strict=True)]
    return np.array([p[0] for p in parts]), np.array([p[1] for p in parts])


@dataclass
class Whitener:
    """``axes`` are unit eigenvectors as columns by falling eigenvalue, ``values`` their eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray

    def project(self, e: np.ndarray) -> tuple[list[int], np.ndarray]:
        """For vectors, the exact sum of squares of n * x less the sums, and their whitened coordinates."""
        x, sums = _whole(e).astype(np.int64), self.sums
        # whole numbers of any size where 64 bits may not hold them
        wide = self.n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums)) >= 1 << 62
        away = x.astype(object) * self.n - np.array(sums, dtype=object) if wide else x * self.n - np.array(sums, dtype=np.int64)
        most = max(int(away.max(initial=0)), -int(away.min(initial=0)))
        square = away.astype(object) if most * most * e.shape[1] >= 1 << 63 else away
        y = away.astype(np.float64) / self.n
        return (square * square).sum(1).tolist(), y @ self.axes / np.sqrt(self.values)


def fit_whitening(rows: DataFrame, components: int = 8) -> Whitener | None:
    """The whitening of all ``rows`` (as ``usable`` gives them, of one length); None if there are none.

    Components without variance, but for rounding, cannot be whitened and are left out.
    """
    found = _sizes_and_sums(rows)
    if not found:
        return None
    d = max(found, key=lambda k: (found[k][0], k))
    n, sums = found[d]
    parts = [_split(Fraction(s, n)) for s in sums]
    mean = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    high, low = compensated_products(rows.where(F.size("e") == d), "e", mean, whole=True)
    covariance = (high.astype(np.longdouble) + low.astype(np.longdouble)) / n
    values, axes = symmetric_eigen(covariance)
    k = int((values[:components] > d * np.finfo(np.float64).eps * max(values[0], 0)).sum())
    explained = (values / np.trace(covariance))[:k] if k else values[:0]
    return Whitener(n, sums, *(np.asarray(x, dtype=np.float64) for x in (values[:k], axes[:, :k], explained)))


def whiten(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each vector and component.

    The entries c of a vector count as x = floor(1024 * c) + 100000. ``deviation`` is the exact sum of
    (n * x - S)^2, S being the sums, as decimal(38, 0), null where that is too small; ``whitened`` the
    projection of x - S / n on the component over the root of its eigenvalue; ``explained`` its share
    of all variance; ``identity_error`` the largest absolute entry of what the covariance of all
    projections has more than the identity.

    Rows whose vector is null, empty or not finite throughout are dropped, and so are rows of other
    lengths than the most frequent one (of those that tie, the largest). Each row counts, also rows
    that repeat or have no id. Without rows, or where all are the same, there is no component and
    no row. Other columns are ignored.
    """
    spark, rows = embeddings.sparkSession, usable(embeddings)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fitted = fit_whitening(rows, components)
    if fitted is None or not len(fitted.values):
        return spark.createDataFrame([], schema)
    known = spark.sparkContext.broadcast(fitted)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            squares, w = known.value.project(_matrix(batch.column("e")))
            exact = [Decimal(s) if s < 10**38 else None for s in squares]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(exact, pa.decimal128(38, 0)), listed], ["vec_id", "deviation", "w"])

    projected = durable(rows.where(F.size("e") == len(fitted.sums)).mapInArrow(project, "vec_id long, deviation decimal(38,0), w array<double>"))
    k = len(fitted.values)
    high, low = compensated_products(projected, "w", _mean(projected, "w", k, fitted.n))
    error = float(np.abs((high + low) / fitted.n - np.eye(k)).max())
    return projected.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*[F.lit(float(x)) for x in fitted.explained]), F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
