"""Embedding near-duplicates, Jaccard join and suffix-array removal against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import embedding_dedup, jaccard_join, suffix_dedup
from lexforge.llm._shared import components
from lexforge.llm.embedding_dedup import CoverTree, near_duplicates
from lexforge.llm.jaccard_join import jaccard_components
from lexforge.llm.suffix_dedup import SuffixArray, remove_repeats

DOCS = "doc_id long, text string, id long, tokens string, lead string"


def reached(n, pairs):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 99), (99, 98), (200, 200), (7, 3), (7, 3)] + [(500, x) for x in range(501, 560)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: 1 for x in range(2, 61)} | {99: 98, 100: 98} | {x: 500 for x in range(501, 560)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_take_few_tasks(spark):
    """However many partitions edges and shuffles have."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        found = components(spark.range(1, 60).selectExpr("id as a", "id + 1 as b").repartition(30))
        assert found.rdd.getNumPartitions() == 1 and {r.root for r in found.collect()} == {1}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8))
    blob = base[0] + rng.normal(scale=0.02, size=(400, 8))
    wide = base[1] + rng.normal(scale=0.25, size=(200, 8))
    rows = [*base, *blob, *wide, *[base[2]] * 30, *(base[3] * s for s in (0.5, 2, 3)), -base[4]]
    labels = [1 if i % 5 else 2 for i in range(len(rows))]
    for i in range(60, 460):
        labels[i] = 1
    out = [(i, [float(np.float32(x)) for x in v], lab, "x") for i, (v, lab) in enumerate(zip(rows, labels, strict=True))]
    n = len(out)
    odd = [None, [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [], [1.0, 2.0]]
    out += [(n + k, v, 1, "x") for k, v in enumerate(odd)]
    out += [(n + 100, out[0][1], None, "x"), (None, out[0][1], 1, "x")]
    return out


@pytest.mark.parametrize("leaf", [24, 1024])
def test_near_duplicate_vectors(spark, leaf):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string").repartition(3)
    found = {r.vec_id: r for r in near_duplicates(df, leaf=leaf).collect()}
    assert len(found) == len(rows)
    good = [i for i, v, lab, _ in rows if i is not None and lab is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    x = {r[0]: np.array(r[1], float) for r in rows if r[0] in set(good)}
    lab = {r[0]: r[2] for r in rows}
    pairs = [(a, b) for k, a in enumerate(good) for b in good[:k] if lab[a] == lab[b] and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= 0.98]
    links = Counter(i for p in pairs for i in p)
    root = reached(max(good) + 1, pairs)
    for i in found:
        if i is not None:
            assert found[i].n_links == links[i], i
            assert found[i].component_id == (root[i] if i in x else i)
            assert found[i].kept == (found[i].component_id == i)
    assert (found[None].n_links, found[None].component_id, found[None].kept) == (0, None, False)


def test_no_vectors_and_repeated_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = near_duplicates(spark.createDataFrame([(4, [1.0, 0.0], 1)] * 3, schema)).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in rows] == [(4, 2, 4, True)] * 3


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def linked(texts, k, percent):
    sets, where, pairs = [shingles(t, k) for t in texts], defaultdict(list), []
    for i, s in enumerate(sets):
        both = Counter(j for t in s for j in where[t])
        pairs += [(j, i) for j, n in both.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)]
        for t in s:
            where[t].append(i)
    return sets, reached(len(texts), pairs)


def texts():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 4)))
    out = [" ".join(word() for _ in range(draw.choice([0, 1, 2, 3, 5, 12, 40, 200]))) for _ in range(60)]
    passage = [word() for _ in range(30)]
    for size in (60, 150):
        base = [word() for _ in range(size)]
        for _ in range(120):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(size)] = word()
            out.append(" ".join(copy))
    out += [" ".join([*passage, *(word() for _ in range(draw.choice([2, 60])))]) for _ in range(80)]
    out += ["", None, "  \n ", "One", "one ONE", "ONE one", "É a b", "é a b", "x y z w", "same words here " * 50, "same words here " * 60]
    out += [out[3]] * 40
    out.append(" ".join(word() for _ in range(30_000)))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard(spark, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PART_DOCS", 50)  # several parts in a group
    rows = texts()
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(rows)], DOCS).repartition(3)
    found = {r.doc_id: r for r in jaccard_components(df, k, percent).collect()}
    sets, root = linked(rows, k, percent)
    assert len(found) == len(rows)
    for i in found:
        assert (found[i].n_shingles, found[i].component_id) == (len(sets[i]), root[i] if sets[i] else i), rows[i]


def test_jaccard_without_ids_or_rows(spark):
    df = spark.createDataFrame([(None, "a b c d", 1, "", ""), (7, "a b c d", 1, "", ""), (7, "a b c d", 1, "", "")], DOCS)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()) == [(0, 2, 7), (7, 2, 7), (7, 2, 7)]
    assert jaccard_components(df.limit(0)).count() == 0


def left(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans, kept = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages():
    draw = random.Random(9)
    some = lambda n: "".join(draw.choice("abcdefgh é\n") for _ in range(n))
    shared = [some(n) for n in (199, 200, 201, 350, 900)]
    out = [some(draw.choice([0, 5, 190, 300, 2000])) for _ in range(40)]
    for p in shared:
        out += [some(draw.randint(0, 300)) + p + some(draw.randint(0, 300)) for _ in range(25)]
    out += ["ab" * 400, "a" * 199, "a" * 200, "a" * 201, "\0" * 300, None, "", out[2] * 2, shared[2] + shared[3]]
    out += [out[4]] * 20 + [some(60_000) + shared[4]]
    return out


@pytest.mark.parametrize(("shard", "levels"), [(2_000_000, 4), (3_000, 0), (3_000, 1), (1_500, 4)])
def test_repeats(spark, shard, levels, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)  # small ones are cut again, and merged by binary search after the last level
    monkeypatch.setattr(suffix_dedup, "LEVELS", levels)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 3 if levels == 4 else 20_000)
    rows = passages()
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(rows)], DOCS).repartition(3)
    found = remove_repeats(df).select("doc_id", F.sha2("kept", 256).alias("sha"), "spans").collect()
    expected = left(rows, 200)
    assert len(found) == len(rows)
    for r in found:
        assert (sum(s["to"] - s["from"] for s in r.spans), len(r.spans), r.sha) == expected[r.doc_id], r.doc_id


@pytest.mark.parametrize(("shard", "levels"), [(2_000_000, 4), (3_000, 0), (1_500, 4)])
def test_repeats_of_rows_without_or_with_repeated_ids(spark, shard, levels, monkeypatch):
    """Every row is judged by its own text: rows that share an id, with one text or several, and rows without an id."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "LEVELS", levels)
    draw = random.Random(5)
    some = lambda n: "".join(draw.choice("abcdefgh é") for _ in range(n))
    shared, other = some(400), some(260)
    rows = [(1, some(300) + shared), (1, shared + some(300)), (1, some(500)), (None, some(90) + other), (None, other + some(70)), (0, other), (2, some(250))]
    rows += [(3, some(260))] * 2 + [(None, "z" + shared[1:390])] * 3 + [(None, None), (4, None), (4, ""), (4, some(199))]
    for p in (some(200), some(230), some(900)):  # copies, one of them or all without an id, share a passage but no whole segment with others
        copy, part, alone = some(150) + p + some(150), some(150) + p + some(150), some(500)
        rows += [(None, copy), (None, copy), (len(rows) + 100, copy), (None, part), (None, part), (None, some(90) + p[:210]), (len(rows) + 50, some(80) + p + some(120))]
        rows += [(None, alone), (len(rows) + 200, some(40) + alone[100:320] + some(70))]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], DOCS).repartition(4)
    found = remove_repeats(df).select("doc_id", F.sha2("kept", 256).alias("sha"), "spans").collect()
    got = Counter((r.doc_id, sum(s["to"] - s["from"] for s in r.spans), len(r.spans), r.sha) for r in found)
    assert got == Counter((i, *e) for (i, _), e in zip(rows, left([t for _, t in rows], 200), strict=True))
    probe = [r for r in found if r.doc_id == 1 and r.spans]
    assert sorted((s["from"], s["to"]) for r in probe for s in r.spans)[0][0] == 0 and len(probe) == 2
    assert remove_repeats(df.limit(0)).count() == 0


def test_suffix_arrays():
    draw = random.Random(2)
    for _ in range(60):
        n = draw.choice([8, 12, 20])
        strings = [bytes(draw.choice(b"ab\0") for _ in range(draw.randint(n, 60))) for _ in range(draw.randint(1, 6))]
        strings.append(strings[0][3:] + b"ababab" * 3)
        strings = [s for s in strings if len(s) >= n]
        one = SuffixArray(strings)
        raw = one.text[: one.n].tobytes()
        assert one.order.tolist() == sorted(range(one.n), key=lambda i: raw[i:])
        count = Counter(s[i : i + n] for s in strings for i in range(len(s) - n + 1))
        first = SuffixArray(strings[:1]).holds(strings, n)
        for s, hit, held in zip(strings, one.repeated(n), first, strict=True):
            assert hit.tolist() == [count[s[i : i + n]] > 1 for i in range(len(s) - n + 1)]
            assert held.tolist() == [s[i : i + n] in strings[0] for i in range(len(s) - n + 1)]


@pytest.mark.parametrize("spread", [1.0, 0.01])
def test_trees_prune_without_losing_links(spread):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(30, 4)), 30, axis=0) + rng.normal(scale=spread, size=(900, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    one, two = CoverTree(x), CoverTree(x[:300])
    for tree, other, y in ((one, None, x), (one, two, x[:300])):
        found = Counter()
        for i, j, whole in embedding_dedup._links(tree, other, 0.98, 0.2):
            found.update((a, b) for a in i for b in j) if whole else found.update(zip(i.tolist(), j.tolist(), strict=True))
        expected = set(zip(*np.nonzero(x @ y.T >= 0.98), strict=True))
        if other is None:
            own = [p for p in found if p[0] != p[1]]
            assert {(min(p), max(p)) for p in own} == {p for p in expected if p[0] < p[1]}
        else:
            assert set(found) == expected and set(found.values()) == {1}


def test_levels_are_nested_and_radii_halve():
    x = np.random.default_rng(2).normal(size=(700, 6))
    x = np.vstack([x / np.linalg.norm(x, axis=1, keepdims=True)] * 2)
    tree = CoverTree(x, small=4)
    assert sorted(tree.rows(0)) == list(range(len(x)))
    for k in np.flatnonzero(tree.split):
        kids = tree.children[k]
        assert tree.centre[kids[0]] == tree.centre[k] and (tree.radius[kids] <= tree.radius[k] / 2).all()
        assert np.concatenate([tree.rows(m) for m in kids]).tolist() == tree.rows(k).tolist()
        c = x[tree.centre[kids]]
        apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2))[~np.eye(len(c), dtype=bool)]
        assert (apart > tree.radius[k] / 2).all()
    for k in range(len(tree.centre)):
        assert np.sqrt(((x[tree.rows(k)] - x[tree.centre[k]]) ** 2).sum(axis=1)).max() <= tree.radius[k] + 1e-12
