"""Hard negatives and whitening against brute force in whole numbers and fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import hard_negatives, whitening
from lexforge.llm.eigen import symmetric_eigen
from lexforge.llm.entries import op13_embedding_whitening
from lexforge.llm.hard_negatives import mine_hard_negatives
from lexforge.llm.whitening import whiten

ROWS = "vec_id long, embedding array<float>, label int, score long, x string"


def odd_rows(n, size):
    return [(n, None, 1), (n + 1, [1.0, None] + [0.5] * (size - 2), 1), (n + 2, [math.nan] * size, 2), (n + 3, [math.inf] + [0.0] * (size - 1), 2)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 7, "y") for i, v, lab in rows], ROWS).repartition(5)


def mining_rows():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3, 6))
    rows = [(i, [float(np.float32(x)) for x in base[i % 3] + rng.normal(scale=0.6, size=6)], int(rng.integers(0, 3))) for i in range(300)]
    same = rows[17][1]
    rows += [(1000 + i, same, i % 2) for i in range(200)]  # one vector very often, so scores tie
    rows += [(rows[50][0], rows[50][1], rows[50][2]), (rows[9][0], rows[9][1], rows[9][2]), (7, [0.25] * 6, 9), (50, [0.5, 0.5], 1), (51, [0.5, 0.25], 2), (49, [0.5, 0.1], 1)]
    return [*rows, *odd_rows(5000, 6), (None, same, 1), (5010, same, None)]


def mined(rows):
    """All pairs, sorted."""
    taking = []
    for i, v, lab in rows:
        if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            taking.append((i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(math.floor(256 * c) for c in v)))
    out = []
    for anchor in {t for t in taking if t[0] % 50 == 0}:
        scored = [(sum(a * b for a, b in zip(anchor[2], x, strict=True)), i, lab) for i, lab, x in taking if len(x) == len(anchor[2])]
        order = lambda s: (-s[0], s[1])
        for p, pos, _ in sorted((s for s in scored if s[2] == anchor[1] and s[1] != anchor[0]), key=order)[:5]:
            fit = sorted((s for s in scored if s[2] != anchor[1] and 50 * p <= 100 * s[0] <= 95 * p), key=order)[:3]
            out += [(anchor[0], pos, k + 1, neg, p, s) for k, (s, neg, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize(("block", "buckets"), [(2048, 64), (3, 4)])
def test_hard_negatives(spark, monkeypatch, block, buckets):
    monkeypatch.setattr(hard_negatives, "BUCKETS", buckets)
    monkeypatch.setattr(hard_negatives, "SPARE", 1)
    rows = mining_rows()
    found = mine_hard_negatives(table(spark, rows), block=block)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == mined(rows)


def test_hard_negatives_of_large_components(spark):
    """Scores beyond 53 bits are exact; what could leave 63 counts as the largest that cannot."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(scale=1.2e5, size=4) + 3e5], i % 3) for i in range(120)]
    found = sorted(tuple(r) for r in mine_hard_negatives(table(spark, rows)).collect())
    assert found == mined(rows) and max(r[4] for r in found) > 1 << 53
    assert mine_hard_negatives(table(spark, [(50, [3e38] * 4, 1), (51, [3e38] * 4, 1), (52, [1e30] * 4, 2)])).count() == 0


def test_hard_negatives_of_nothing(spark):
    assert mine_hard_negatives(table(spark, [])).collect() == []
    assert mine_hard_negatives(table(spark, [(1, [0.5], 1), *odd_rows(50, 3)])).collect() == []
    assert mine_hard_negatives(table(spark, [(50, [], 1), (51, [], 1), (52, [], 2)])).collect() == [(50, 51, 1, 52, 0, 0)]


def fractions_of(rows):
    kept = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, size = len(kept), len(kept[0][1])
    sums = [sum(v[j] for _, v in kept) for j in range(size)]
    y = [[Fraction(n * v[j] - sums[j], n) for j in range(size)] for _, v in kept]
    cov = [[sum(r[a] * r[b] for r in y) / n for b in range(size)] for a in range(size)]
    return kept, n, sums, np.array([[float(c) for c in r] for r in y]), np.array([[float(c) for c in r] for r in cov])


def whitening_rows(scale=1.0):
    rng = np.random.default_rng(6)
    mix = rng.normal(size=(10, 10)) * scale
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=10) @ mix + 3 * scale], i % 4) for i in range(400)]
    return [*rows, rows[0], (None, rows[1][1], None)]


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_whitening(spark, scale):
    rows = whitening_rows(scale)
    found = whiten(table(spark, [*rows, *odd_rows(900, 10), (990, [0.5] * 4, 1), (991, [], 1)])).collect()
    kept, n, sums, y, cov = fractions_of(rows)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    assert len(found) == 8 * n and {r.n for r in found} == {n} and len({r.identity_error for r in found}) == 1
    assert found[0].identity_error < 1e-9
    deviation = {(i, sum((n * x - s) ** 2 for x, s in zip(v, sums, strict=True))) for i, v in kept}
    assert {(r.vec_id, int(r.deviation)) for r in found} == deviation
    expected = {i: r for (i, _), r in zip(kept, (y @ axes / np.sqrt(values)).tolist(), strict=True)}
    for k in range(8):
        some = [r for r in found if r.component == k + 1]
        sign = math.copysign(1, sum(r.whitened * expected[r.vec_id][k] for r in some))
        assert max(abs(r.whitened - sign * expected[r.vec_id][k]) for r in some) < 1e-9
        assert {r.explained for r in some} == {some[0].explained} and abs(some[0].explained * np.trace(cov) / values[k] - 1) < 1e-9


def test_whitening_query_columns(spark, tmp_path):
    table(spark, whitening_rows()).write.parquet(str(tmp_path / "embeddings.parquet"))
    df = op13_embedding_whitening(spark, str(tmp_path))
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}


def test_whitening_of_few_and_equal_vectors(spark):
    assert whiten(table(spark, [])).collect() == [] and whiten(table(spark, odd_rows(1, 4))).collect() == []
    assert whiten(table(spark, [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)])).collect() == []
    line = whiten(table(spark, [(i, [i * 0.5, i * 0.5, 1.0], 1) for i in range(5)])).collect()
    assert sorted((r.vec_id, r.component, int(r.deviation)) for r in line) == [(i, 1, 2 * (5 * 512 * i - 512 * 10) ** 2) for i in range(5)]
    assert all(abs(abs(r.whitened) - abs(r.vec_id - 2) / math.sqrt(2)) < 1e-12 and abs(r.explained - 1) < 1e-12 for r in line)


def test_transformations_are_free_of_error():
    rng = np.random.default_rng(8)
    a, b = (rng.normal(size=400) * 2.0 ** rng.integers(-200, 200, size=400) for _ in range(2))
    exact = [Fraction(float(x)) for x in a], [Fraction(float(x)) for x in b]
    for f, op in ((whitening.two_sum, lambda x, y: x + y), (whitening.two_product, lambda x, y: x * y)):
        high, low = f(a, b)
        assert [Fraction(float(h)) + Fraction(float(x)) for h, x in zip(high, low, strict=True)] == [op(x, y) for x, y in zip(*exact, strict=True)]


def test_compensated_products_hold_what_doubles_lose(spark):
    rng = np.random.default_rng(9)
    values = np.concatenate([rng.normal(size=(200, 3)) * 1e9, rng.normal(size=(200, 3)) * 1e-6])
    rng.shuffle(values)
    df = spark.createDataFrame([(r,) for r in values.tolist()], "e array<double>").repartition(7)
    high, low = whitening.compensated_products(df, "e", (np.full(3, 0.1), np.full(3, 1e-18)))
    mean = Fraction(0.1) + Fraction(1e-18)
    for i in range(3):
        for j in range(3):
            exact = sum((Fraction(r[i]) - mean) * (Fraction(r[j]) - mean) for r in values.tolist())
            assert abs(Fraction(float(high[i, j])) + Fraction(float(low[i, j])) - exact) <= Fraction(1, 10**26) * 400 * 10**18


@pytest.mark.parametrize("case", ["random", "close", "equal", "low rank", "zero", "one"])
def test_eigenvectors(case):
    rng = np.random.default_rng(10)
    n = 1 if case == "one" else 40
    basis = np.linalg.qr(rng.normal(size=(n, n)))[0]
    spectrum = {"random": rng.random(n), "close": 1 + 1e-10 * np.arange(n), "equal": np.ones(n), "low rank": np.append([3.0, 2, 1], np.zeros(n - 3)) if n > 3 else None, "zero": np.zeros(n), "one": np.ones(1)}[case]
    a = (basis * spectrum) @ basis.T
    a = (a + a.T) / 2
    values, axes = symmetric_eigen(a)
    size = max(np.abs(a).max(), 1)
    assert np.abs(axes.T @ axes - np.eye(n)).max() < 1e-13 and np.abs(a @ axes - axes * values).max() < 1e-14 * size
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 and (np.diff(values) <= 0).all()


def test_scores_are_ordered_by_spark_too(spark):
    df = mine_hard_negatives(table(spark, mining_rows()))
    assert df.where(F.col("negative_score") * 100 > F.col("positive_score") * 95).count() == 0
