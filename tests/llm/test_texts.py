"""Operators on single documents, models, archives and mixtures."""

import base64
import gzip
import hashlib
import math
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from lexforge.llm import byte_bpe, private_data, quality_classifier, source_mixture, toxicity
from lexforge.llm.byte_bpe import encode, encoded_digests
from lexforge.llm.private_data import find_private, redact, spans_text
from lexforge.llm.quality_classifier import score_quality
from lexforge.llm.quality_rules import judge
from lexforge.llm.source_mixture import mix, mixed_documents, mixture_report, permuted
from lexforge.llm.toxicity import score_toxicity
from lexforge.llm.warc import assemble, read_records, resolve, write_warc

RANKS = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()  # noqa: SIM115
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOCS)


def odd_texts():
    draw = random.Random(4)
    chars = "ab cdé'sth\x1c\x85 　\n\t  '0123٣ñ中文🙂́‍²½퟿!!"
    return [None, "", " ", "a" * 5000, "don't  stop\n\n now", *("".join(draw.choice(chars) for _ in range(draw.randint(0, 40))) for _ in range(400))]


def test_bpe(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts()
    found = encoded_digests(docs(spark, texts), RANKS, public_tokenizers.PATTERN).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = own.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_bpe_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", "old")], "x long, text string, ids string")
    row = encode(df, RANKS, public_tokenizers.PATTERN).first()
    assert (row.x, row.text, len(row.ids)) == (1, "a b", 8)
    assert encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 3000])
def test_perfect_hash(n):
    keys = [f"k{i}".encode() for i in range(n)]
    table = byte_bpe.PerfectHash(keys)
    assert [table.get(k) for k in keys] == list(range(n)) and len(table.slots) == n
    assert table.get(b"none") == -1


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and double % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_base_spans_equal_the_patterns(spark):
    draw = random.Random(8)
    texts = ["".join(draw.choice("ab.@-+ 0123456789()é") for _ in range(draw.randint(0, 50))) for _ in range(3000)]
    texts += ["4111 1111-1111 1111", "x 010.0.0.01 256.1.1.1 1.2.3.4.5", "a@b.c@d.e @x.y a@b", "+1 (743) 555-3824.", None, ""]
    found = find_private(docs(spark, texts)).select("doc_id", spans_text(F.col("base")).alias("s")).collect()
    assert len(found) == len(texts)
    assert all(r.s == plain_spans(texts[r.doc_id] or "") for r in found)


def test_long_runs_are_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" + " " * 200_000, "a@" * 100_000):
        private_data.base_spans(text)


def test_contexts_find_more(spark):
    numbers = [f"+1 (743) 555-38{i:02d}" for i in range(20)]
    texts = [f"Filler words {i} here. Please call me at {n} this evening." for i, n in enumerate(numbers)]
    texts += ["Please call me at (212) 555-0100 this evening.", "The total was (212) 555-0199 in all."]
    found = {r.doc_id: r.extra for r in find_private(docs(spark, texts)).collect()}
    assert [(s.kind, texts[20][s["from"] : s["to"]]) for s in found[20]] == [("phone", "(212) 555-0100")]
    assert not found[21] and not any(found[i] for i in range(20))
    clean = {r.doc_id: r.text for r in redact(docs(spark, texts)).collect()}
    assert clean[20] == "Please call me at [PHONE] this evening." and "[PHONE]" in clean[0] and clean[21] == texts[21]


def test_contexts_reach_over_long_words(spark):
    """No word beside a string is too long to be read, and chains of patterns are followed to their end."""
    long = "w" * 500
    texts = [f"Filler {long} call at +1 (743) 555-38{i:02d} {long} please." for i in range(20)] + [f"{long} call at (212) 555-0100 {long} please."]
    found = {r.doc_id: r.extra for r in find_private(docs(spark, texts)).collect()}
    assert [texts[20][s["from"] : s["to"]] for s in found[20]] == ["(212) 555-0100"]
    # each link of the chain is believed only through the one before
    number = lambda k: f"(212) 555-01{k:02d}"
    texts = [f"x ask word0 now +1 (743) 555-38{i:02d} then" for i in range(9)]
    for k in range(6):
        texts += [f"x ask word{chr(97 + k)} now {number(k)} then" for _ in range(3)]
        texts += [f"x ask word{'0' if not k else chr(96 + k)} now {number(k)} then"]
    texts = [t.replace("word0", "wordz") for t in texts]
    found = {r.doc_id: r.extra for r in find_private(docs(spark, texts)).collect()}
    assert all(len(found[9 + i]) == 1 for i in range(4 * 6))


def test_columns_that_clash(spark):
    names = ["_id", "_none", "_digest", "_spans", "_hash", "_nth", "_size", "_pieces", "id", "hash", "nth", "size", "pieces", "uses"]
    df = docs(spark, ["mail a@b.com now and then", "x y z", None]).select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    for made in (redact(df), mixed_documents(df)):
        assert made.columns == df.columns
        assert all(tuple(r)[5:] == tuple(range(len(names))) for r in made.collect())
    assert {r.text for r in redact(df).collect()} == {"mail [EMAIL] now and then", "x y z", None}


def test_private_without_ids_or_rows(spark):
    df = spark.createDataFrame([(None, "a@b.com", 1), (None, "x", 1), (3, "a@b.com", 1), (3, "a@b.com", 1)], "doc_id long, text string, base long")
    found = find_private(df).collect()
    assert sorted(len(r.base) for r in found) == [0, 1, 1, 1]
    assert find_private(df.limit(0)).count() == 0


def test_redaction_of_rows_without_ids_and_repeated_ids(spark):
    texts = [(None, "mail a@b.com now"), (None, "nothing here"), (None, "mail a@b.com now"), (None, None), (3, "x c@d.org y"), (3, "long clean text of no one"), (3, "+49 170 1234567 call"), (0, "clean"), (4, "e@f.net"), (4, "e@f.net")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(texts)], "doc_id long, text string, _row long").repartition(3)
    out = redact(df)
    assert out.columns == df.columns
    found = {r._row: (r.doc_id, r.text) for r in out.collect()}
    clean = ["mail [EMAIL] now", "nothing here", "mail [EMAIL] now", None, "x [EMAIL] y", texts[5][1], "[PHONE] call", "clean", "[EMAIL]", "[EMAIL]"]
    assert found == {k: (i, clean[k]) for k, (i, _) in enumerate(texts)}
    assert redact(df.limit(0)).count() == 0


def test_rules(spark):
    good = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", " \n ", "a b c a b c d", "x\nx\n\nx\ny", "### $5 <b> | *", "é é b", good, (good + " ") * 2, "w " * 30_000, "a\tb\x0bc\x0cd\re", "f\nf\nff\nff", "x\n\x0c\n\x0c\n\x0b\n\x0b\nf f\nf f"]
    found = {r.doc_id: r for r in judge(docs(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        seen, again = {}, set()
        for j in range(len(words) - 2):
            if (at := seen.setdefault(tuple(words[j : j + 3]), j)) != j:
                again |= {at, at + 1, at + 2, j, j + 1, j + 2}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again))
        assert tuple(found[i][1:6]) == expected, text
        assert found[i].base_failed == (len(words) < 50 or 100 * len(again) > 50 * len(words))
    assert not any(found[i].kept for i in found if found[i].base_failed)


def test_hosts_share_their_verdict(spark):
    good, bad = " ".join(f"word{i}" for i in range(60)), "too short"
    rows = [(i, bad if i % 10 else good, "en", "spam", 1) for i in range(200)] + [(i, good, "en", f"h{i % 20}", 1) for i in range(200, 600)]
    rows += [(900, good, "en", None, 1), (901, bad, "en", "once", 1)]
    found = {r.doc_id: r for r in judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(found[i].kept for i in range(200)) and not found[0].base_failed
    assert all(found[i].kept for i in range(200, 600)) and found[900].kept and not found[901].kept
    assert judge(spark.createDataFrame([], DOCS)).count() == 0


def labelled(spark, n=900):
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        toxic, junk = i % 9 == 0, i % 7 == 0
        words = ["".join(draw.choice("abcdefg") for _ in range(draw.randint(2, 5))) for _ in range(draw.randint(20, 90))]
        if toxic:
            for w in draw.sample(["vilewort", "vileness", "grimsome", "grimly"], 2):
                words[draw.randrange(len(words))] = w
        if junk:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), draw.choice(["en", "de", None]), draw.choice(["a", "b", None]), 1))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(n, None, None, None, 0), (n + 1, "", "en", "a", 0), (n + 2, "a" * 100_000, "en", "a", 1), (None, "x", "en", "a", 1)]
    labels += [(n, None, None), (None, 1, 1), (10**9, 1, 1), (0, 1, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    df, labels = labelled(spark)
    found = {r.doc_id: r for r in score_toxicity(df, labels).collect()}
    assert len(found) == 904 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    held = [r for i, r in found.items() if i is not None and i < 900 and r.held_out]
    assert len(held) > 120
    assert np.mean([r.predicted == (r.doc_id % 9 == 0) for r in held]) > 0.95
    assert all(r.held_out == (i is None or __import__("zlib").crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert found[900].score == found[901].score < 0.5
    again = {r.doc_id: r.score for r in score_toxicity(df.repartition(5), labels.repartition(2)).collect()}
    assert all(abs(again[i] - found[i].score) < 1e-9 for i in found)


def test_neighbours_are_exact(spark, monkeypatch):
    """Evidence against cosines of TF-IDF vectors made from the texts, with terms told by plain counting."""
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    df, labels = labelled(spark, 700)
    df = df.where("doc_id < 700")
    texts = {r.doc_id: r.text for r in df.collect()}
    toxic = {}
    for r in labels.where("doc_id < 700").collect():
        toxic[r.doc_id] = max(toxic.get(r.doc_id, 0), r.toxic)
    known = sorted(i for i in toxic if zlib.crc32(str(i).encode()) % 5)
    bags = {i: Counter(x for w in WORD.findall(t.lower()) for x in (("word", w), ("head", w[:5]))) for i, t in texts.items()}
    n, m = 1 + sum(toxic[i] for i in known), 1 + sum(not toxic[i] for i in known)
    a, b = (Counter(t for i in known if toxic[i] == k for t in bags[i]) for k in (1, 0))
    odds = {t: math.log((a[t] + 0.5) / n) - math.log((b[t] + 0.5) / m) for t in a | b}
    terms = {t for t, x in odds.items() if a[t] + b[t] >= 3 and x > 1 and x / math.sqrt(1 / (a[t] + 0.5) + 1 / (b[t] + 0.5)) > 1.64}
    held = Counter(t for x in bags.values() for t in x)
    vectors = {}
    for i, x in bags.items():
        v = {t: (1 + math.log(k)) * (math.log((1 + len(texts)) / (1 + held[t])) + 1) for t, k in x.items() if t in terms}
        size = math.sqrt(sum(w * w for w in v.values()))
        vectors[i] = {t: w / size for t, w in v.items()}
    found = {r.doc_id: r.evidence for r in score_toxicity(df, labels).collect()}
    assert len(terms) > 4 and sum(map(bool, vectors.values())) > 70
    for i, v in vectors.items():
        every = sorted((sum(w * vectors[j].get(t, 0) for t, w in v.items()) for j in known), reverse=True)
        cosines = [e.cosine for e in found[i]]
        assert np.allclose(cosines, [c for c in every[:3] if c > 0]), i
        for e in found[i]:
            assert abs(sum(w * vectors[e.doc_id].get(t, 0) for t, w in v.items()) - e.cosine) < 1e-9 and e.toxic == toxic[e.doc_id]


def test_quality(spark):
    df, labels = labelled(spark)
    found = {r.doc_id: r for r in score_quality(df, labels).collect()}
    held = [r for i, r in found.items() if i is not None and i < 900 and r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 7 != 0) for r in held]) > 0.97 and len(found) == 904


def test_all_unlabelled_rows_teach(spark):
    """What a rare source is like is known from its text alone, wherever a hash of the ids puts its rows."""
    df, labels = labelled(spark)
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    ids = [r.id for r in spark.range(10_000, 10_900).where(draw < 0.5).where(~toxicity.held_out("id")).limit(150).collect()]
    text = lambda i: " ".join(f"{'abcdefg'[(i * j) % 7]}{'gfedcba'[(i + j) % 7]}".upper() + "!!" for j in range(40))
    rare = [(i, text(i), "xx", "rare", 1) for i in ids]
    apart = [(k, "abc de fg", "xx", source, 1) for k, source in ((20_000, "rare"), (20_001, "other"))]
    found = {r.doc_id: r for r in score_quality(df.union(spark.createDataFrame(rare + apart, df.schema)), labels).collect()}
    assert found[20_000].metadata_score < found[20_001].metadata_score - 1e-4


def test_rounds_sum_over_all_rows(spark):
    df, labels = labelled(spark)
    models = [np.random.default_rng(k).normal(0, 3, n) for k, n in enumerate(quality_classifier._SIZES)]
    rows = df.collect()
    views = quality_classifier._views([r.text.encode() if r.text else None for r in rows], [r.lang for r in rows], [r.source for r in rows])
    bounds = quality_classifier._teach(df.repartition(5), models)
    for k, b in enumerate(bounds):
        p = 1 / (1 + np.exp(-np.clip(views[1 - k].times(models[1 - k]), -30, 30)))
        sure = np.flatnonzero(np.abs(p - 0.5) >= 0.45)
        assert 0 < len(sure) and b.weight == len(sure) * quality_classifier.GIVEN_WEIGHT
        mine, y = views[k].some(sure), (p >= 0.5)[sure]
        loss = lambda w: quality_classifier.GIVEN_WEIGHT * np.logaddexp(0, (1 - 2 * y) * mine.times(w)).sum()  # noqa: B023, E731
        draw = np.random.default_rng(9)
        for size in (1e-4, 0.1, 2):
            step = draw.normal(0, size, len(b.at))
            bound = loss(b.at) + b.gradient @ step + (b.curve * step * step).sum() / 2
            assert loss(b.at + step) <= bound + 1e-6 and (size > 1e-3 or abs(loss(b.at + step) - bound) < 0.05)


def test_driver_holds_the_labelled_sample_once(spark):
    """Neither the texts of the sample nor several copies of its views stand in the driver at once."""
    text = lambda i: " ".join(f"w{i * j * j % 99_991}" for j in range(1, 601))
    df = spark.range(1, 2401).select(F.col("id").alias("doc_id"), F.udf(text)("id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    df = df.localCheckpoint()
    labels = df.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    values = 2400 * 0.8 * 590
    tracemalloc.start()
    try:
        quality_classifier.train(df, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 * values, peak / values


def test_models_without_labels(spark):
    df, labels = labelled(spark, 20)
    none = labels.limit(0)
    assert {r.predicted for r in score_toxicity(df, none).collect()} == {0}
    assert {r.predicted for r in score_quality(df, none).collect()} == {1}
    assert score_toxicity(df.limit(0), labels).count() == 0 and score_quality(df.limit(0), labels).count() == 0


def test_archives(spark, tmp_path):
    long = "<p>\r\n\r\nWARC/1.1\r\n" + "é" * 100
    rows = [(3, "http://a", long), (1, "http://b\r\nX: y", long), (2, None, long), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "z" * 70_000), (1, "http://b\r\nX: y", long)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "warc")
    write_warc(df, path, pages_per_file=2)
    captures = assemble(read_records(spark, path)).collect()
    assert len(captures) == len(rows) and all(c.request and c.metadata and bool(c.response) != bool(c.revisit) for c in captures)
    contents = sorted(bytes(c.response.content).decode() for c in captures if c.response)
    assert contents == sorted([long, long, "", "", "short", "short", "z" * 70_000])
    found = sorted(map(tuple, resolve(assemble(read_records(spark, path, payloads=False))).collect()), key=repr)
    text = lambda h: (h or "").encode()
    expected = [
        (i, len(text(h)), hashlib.sha256(text(h)).hexdigest(), "revisit" if h == long and i != 1 else "response", 1 if h == long and i != 1 else None)
        for i, _, h in rows
    ]
    assert found == sorted(expected, key=repr)


def test_archives_of_others(spark, tmp_path):
    """An archive with a gzip member for each record, and one that is not compressed; few bytes to an archive."""
    rows = [(i, f"http://h/{i} x", "p" * 150 + str(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    write_warc(df, str(tmp_path / "plain"), archive_bytes=300, compression="none")
    written = sorted((tmp_path / "plain").glob("part-*"))
    assert len(written) > 8
    (tmp_path / "other").mkdir()
    total = 0
    for k, path in enumerate(written):
        members = []
        for part in path.read_bytes().split(b"WARC/1.1\r\n")[1:]:
            head, _, block = part.partition(b"\r\n\r\n")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n"))
            assert len(block) == int(fields[b"Content-Length"]) + 4 and block.endswith(b"\r\n\r\n")
            if fields[b"WARC-Type"] in (b"response", b"revisit"):
                http, _, payload = block[:-4].partition(b"\r\n\r\n")
                assert http.startswith(b"HTTP/1.1 200 OK\r\n") and fields[b"Content-Type"].startswith(b"application/http")
                assert len(payload) in ((151,) if fields[b"WARC-Type"] == b"response" else (0,))
                total += 1
            members.append(gzip.compress(b"WARC/1.1\r\n" + part))
        (tmp_path / "other" / f"{k}.warc.gz").write_bytes(b"".join(members))
    assert total == len(rows)
    plain = sorted(map(tuple, resolve(assemble(read_records(spark, str(tmp_path / "plain")))).collect()), key=repr)
    other = sorted(map(tuple, resolve(assemble(read_records(spark, str(tmp_path / "other"), files="*.warc.gz"))).collect()), key=repr)
    assert plain == other and [r[4] for r in sorted(plain)] == [None if i < 5 else i % 5 for i in range(40)]


def test_archives_with_faults(spark, tmp_path):
    """Records without a length, a type, an id or an HTTP head, and bytes that are no UTF-8."""
    ends = "\r\n"
    kinds = [
        ["WARC/1.0", "WARC-Type: response", "WARC-Record-ID: <a>", "Content-Type: application/http; msgtype=response", "Content-Length: 4", "", "body"],
        ["WARC/1.0", "WARC-Type: metadata", "WARC-Record-ID: <b>", "", "page_id: 7", "x: y"],
        ["WARC/1.1", "Content-Length: 3", "", "abc"],
        ["WARC/1.0", "WARC-Type: resource", "WARC-Record-ID: <c>", "Content-Length: x", "", "one", "", "two"],
    ]
    (tmp_path / "part-0").write_bytes(b"".join(ends.join(k).encode() + b"\r\n\r\n" for k in kinds) + b"WARC/1.0\r\nX: \xff\r\nContent-Length: 1\r\n\r\n\xfe")
    found = read_records(spark, str(tmp_path)).collect()
    assert [(r.record_id, r.type, bytes(r.content)) for r in found] == [("<a>", "response", b"body"), ("<b>", "metadata", b"page_id: 7\r\nx: y"), (None, None, b"abc"), ("<c>", "resource", b"one\r\n\r\ntwo"), (None, None, b"\xfe")]
    assert found[1].fields == {"page_id": "7", "x": "y"}
    assert assemble(read_records(spark, str(tmp_path))).count() == 4


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "warc")
    write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert resolve(assemble(read_records(spark, path))).count() == 0


def mixture_rows():
    draw = random.Random(7)
    rows = []
    for i in range(1500):
        source = draw.choice(["big"] * 20 + ["b", "é", "Z", "", None])
        rows.append((i, " ".join(["w"] * draw.choice([0, 1, 3, 40, 300])), "en", source, 1))
    return [*rows, (2000, None, "en", "big", 0), (2001, "w " * 5000, "en", "b", 1), (2001, "w " * 5000, "en", "b", 1), (None, "a b c", "en", "b", 1)]


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(source_mixture, "BUCKET_DOCS", 100)
    rows = mixture_rows()
    df = spark.createDataFrame(rows, DOCS)
    found = mixture_report(df, shard_blocks=500).collect()
    assert len(found) == len(rows)
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), 1.5 * sum(size.values())
    while over := {s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]}:
        for s in over:
            target[s] = 2 * size[s]
        open_ -= over
        rest = 1.5 * sum(size.values()) - sum(target.values())
    target |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
    sources = {i: s for i, _, _, s, _ in rows}
    taken = {}
    for r in found:
        s = sources[r.doc_id]
        assert (r.source_size, r.target) == (size[s], pytest.approx(target[s])) and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= max(130, 0.02 * target[s]) for s in size)
    again = mixture_report(df.repartition(7), shard_blocks=500).collect()
    assert sorted(found, key=repr) == sorted(again, key=repr)


def test_mixture_output(spark):
    df = spark.createDataFrame(mixture_rows(), DOCS)
    plan = mix(df, shard_blocks=500)
    slots = plan.slots.toPandas()
    assert slots["shard"].nunique() > 1 and not slots.duplicated(["source", "pass", "block"]).any()
    words = plan.blocks().agg(F.sum(F.col("high") - F.col("low"))).first()[0]
    report = mixture_report(df, shard_blocks=500).agg(F.sum("taken")).first()[0]
    out = mixed_documents(df, shard_blocks=500)
    assert out.columns == df.columns
    assert words == report == sum(len(r.text.split()) for r in out.collect())


def test_mixture_holds_few_texts(spark, monkeypatch):
    """A task makes the passes of a few documents at a time, however many a batch has."""
    df = spark.createDataFrame(mixture_rows()[:5], DOCS)
    tasks, plain = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *rest, **more: tasks.append(f) or plain(self, f, *rest, **more))
    names = mixed_documents(df).columns
    n, text = 4000, " ".join(f"word{j}" for j in range(300))
    pieces = [[{"low": 64, "high": 300, "uses": 2}, {"low": 0, "high": 64, "uses": 1 + i % 2}] for i in range(n)]
    own = {"doc_id": pa.array(range(n)), "text": pa.array([text] * n), "lang": pa.array(["en"] * n), "source": pa.array(["a"] * n), "n_chars": pa.array([len(text)] * n)}
    batch = pa.RecordBatch.from_pydict(own | {"_size": pa.array([300] * n), "_pieces": pa.array(pieces)}).slice(1)
    most, seen, before = 0, Counter(), pa.total_allocated_bytes()
    for out in tasks[-1](iter([batch])):
        most = max(most, pa.total_allocated_bytes() - before)
        assert out.schema.names == names
        seen.update(zip(out.column("doc_id").to_pylist(), out.column("text").to_pylist(), out.column("n_chars").to_pylist(), strict=True))
        del out
    assert most < batch.nbytes / 4
    part = text[text.index("word64 ") :]
    assert seen == Counter({(i, text, len(text)): 1 + i % 2 for i in range(1, n)} | {(i, part, len(part)): 1 for i in range(2, n, 2)})


def test_mixture_writes_few_files(spark):
    """The short rows that a mixture keeps do not make a file for each partition of the texts."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    folder = Path(path.toUri().getPath())
    before = set(folder.glob("rdd-*/part-*"))
    mixed_documents(spark.createDataFrame(mixture_rows(), DOCS).repartition(40))
    assert 0 < len(set(folder.glob("rdd-*/part-*")) - before) < 20


def test_mixture_of_nothing(spark):
    assert mixture_report(spark.createDataFrame([], DOCS)).count() == 0
    rows = mixture_report(spark.createDataFrame([(1, None, "en", "a", 0), (2, " ", "en", None, 0)], DOCS)).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_permutations(n):
    assert sorted(permuted(np.arange(n), n, 17).tolist()) == list(range(n))
