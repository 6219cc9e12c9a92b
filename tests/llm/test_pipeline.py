"""The pipeline's stages, each against a plain version on its own input."""

import base64
import os
import re
import struct
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lexforge.llm.private_data import base_spans
from lexforge.llm.quality_classifier import score_quality
from lexforge.llm.source_mixture import mixture_report

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def components(texts, k, percent):
    sets, where, root = {}, defaultdict(list), {i: i for i in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(texts):
        words = (texts[i] or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
        both = Counter(j for t in sets[i] for j in where[t])
        for j, n in both.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
        for t in sets[i]:
            where[t].append(i)
    return {i: top(i) for i in texts}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        tables.append(docs)
        assert docs.columns[: len(columns)] == columns
    first, good, single, clean, mixed, tokens = ({r.doc_id: r.text for r in t.collect()} for t in tables)

    scores = {r.doc_id: r.predicted for r in score_quality(tables[0], spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    assert good == {i: t for i, t in first.items() if scores[i] == 1} and len(good) < len(first)

    root = components(good, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    assert single == {i: t for i, t in good.items() if root[i] == i} and len(single) < len(good)

    assert set(clean) == set(single)
    for i, text in single.items():
        spans = base_spans(text)
        assert bool(spans) <= (clean[i] != text)
        assert not spans or not base_spans(clean[i])

    taken = {r.doc_id: r.taken for r in mixture_report(tables[3]).collect()}
    words = Counter()
    for r in tables[4].collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    assert words == Counter({i: n for i, n in taken.items() if n})
    assert set(mixed) == {i for i, n in taken.items() if n}

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}  # noqa: SIM115
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert tokens == mixed
    for r in tables[5].collect():
        ids = own.encode_ordinary(r.text)
        assert r.n_tokens == len(ids) and bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).columns[-2:] == ["ids", "n_tokens"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_quality_judges_rows(spark):
    """Rows without an id and rows that share one go or stay by their own texts."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    verdict = {r.doc_id: r.predicted for r in score_quality(docs, labels).collect()}
    rows = [tuple(r) for r in docs.collect()]
    good, bad = ([r for r in rows if verdict[r[0]] == k][:5] for k in (1, 0))
    more = [(None, *r[1:]) for r in good + bad] + [(77_000_000, *r[1:]) for r in good + bad] + [good[0]] * 3
    df = spark.createDataFrame(rows + more, SCHEMA)
    out = corpus_pipeline.quality(spark, df, DATA)
    assert out.columns == df.columns
    judged = out.collect()
    scored = Counter((r.doc_id, r.predicted) for r in score_quality(df, labels).collect())
    for i in (None, 77_000_000):
        assert sum(r.doc_id == i for r in judged) == scored[i, 1] and 0 < scored[i, 1] < 10
    texts = Counter((r.doc_id is None, r.text) for r in judged if r.doc_id in (None, 77_000_000))
    assert all(texts[True, r[1]] == texts[False, r[1]] for r in good + bad)
    assert sum(r.doc_id == good[0][0] for r in judged) == 4
    assert corpus_pipeline.quality(spark, df.limit(0), DATA).count() == 0


def test_one_row_of_each_group_stays(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(100))
    near = lambda x: text(x) + " more"
    texts = [
        (None, text("a")), (None, text("a")), (None, near("a")),  # no ids: one of them stays
        (9, text("b")), (None, near("b")), (None, text("b")),  # the one with an id stays
        (5, text("c")), (5, text("c")), (5, text("c")),  # exact repeats: one stays
        (6, text("d")), (6, text("e")), (6, near("e")), (3, text("e")),  # one id, two groups
        (20, text("f")), (10, near("f")), (None, text("g")),
        (None, None), (None, " "), (30, ""), (31, ""), (30, ""),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA).repartition(3).withColumn("_row", F.lit(1)).withColumn("_several", F.lit(2))
    out = corpus_pipeline.near_duplicates(spark, df, DATA)
    assert out.columns == df.columns
    found = Counter((r.doc_id, (r.text or " ").split(" ")[0]) for r in out.collect())
    assert found == Counter({(None, "a0"): 1, (9, "b0"): 1, (5, "c0"): 1, (6, "d0"): 1, (3, "e0"): 1, (10, "f0"): 1, (None, "g0"): 1, (None, ""): 2, (30, ""): 1, (31, ""): 1})
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), DATA).count() == 0
