"""Language identification against a plain Kneser-Ney model and on held-out rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexforge.llm import language_id
from lexforge.llm.language_id import Scorer, identify, predict_language, train, word_bits

DOCS = "doc_id long, text string, lang string, source string, bits double, lang_pred string"
WORDS = {"en": "the of and river stone window hand after garden winter thing light water".split(), "de": "der und nicht straße fenster wasser garten über winter hände licht stein".split(), "ру": "река камень окно рука сад зима свет вода время город".split()}


def corpus(n=240, seed=1):
    draw = random.Random(seed)
    return [(i, " ".join(draw.choice(WORDS[lang]) for _ in range(draw.randint(3, 30))).capitalize() + ".", lang) for i in range(n) for lang in [list(WORDS)[i % 3]]]


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", 1.0, "x") for r in rows], DOCS).repartition(3)


def teaches(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 != 0


def plain_models(texts):
    """Kneser-Ney by dictionaries: lang -> p(sign, signs before)."""
    out, signs = {}, {c for _, t in texts for c in re.findall(r"[^\W\d_]", t.lower())} | {"$"}
    for lang in {x for x, _ in texts}:
        words = Counter(w for x, t in texts if x == lang for w in re.findall(r"[^\W\d_]+", t.lower()))
        raw = Counter()
        for w, n in words.items():
            s = f"^{w}$"
            for k in range(1, 5):
                for i in range(len(s) - k + 1):
                    raw[s[i : i + k]] += n
        del raw["^"]
        count = {}
        for g, n in raw.items():
            before = len({h[0] for h in raw if len(h) == len(g) + 1 and h[1:] == g})
            count[g] = n if len(g) == 4 or g[0] == "^" else before or 1
        discount = {}
        for k in range(1, 5):
            n1, n2 = (sum(1 for g, n in count.items() if len(g) == k and n == c) for c in (1, 2))
            discount[k] = min(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.95)
        total, kinds = Counter(), Counter()
        for g, n in count.items():
            total[len(g), g[:-1]] += n
            kinds[len(g), g[:-1]] += 1

        out[lang] = chance(count, discount, total, kinds, 1 / (len(signs) + 1))
    return out


def chance(count, discount, total, kinds, least):
    def p(sign, before):
        k = len(before) + 1
        rest = p(sign, before[1:]) if before else least
        if not total[k, before]:
            return rest
        return max(count.get(before + sign, 0) - discount[k], 0) / total[k, before] + discount[k] * kinds[k, before] / total[k, before] * rest

    return p


def test_model_against_dictionaries(spark):
    rows = corpus()
    model = train(table(spark, rows))
    sample = language_id._sample(table(spark, rows)).where("not apart").collect()
    assert len(sample) > 100
    plain = plain_models([(r.lang, r.text) for r in sample])
    assert model.languages == sorted(plain)
    for word in ["the", "stone", "straße", "zzz", "w", "река", "thexде", "винтер"]:
        codes = np.array([ord(c) for c in word])
        bits = word_bits(model, codes, np.array([0]), np.array([len(word)]))[0]
        s = f"^{word}$"
        for lang, found in zip(model.languages, bits, strict=True):
            expected = 0.0
            for i in range(1, len(s)):
                expected -= math.log2(plain[lang](s[i], s[max(0, i - 3) : i]))
            assert abs(found - expected) < 1e-4 * expected, (word, lang)
    signs = {c for r in sample for c in re.findall(r"[^\W\d_]", r.text.lower())} | {"$"}
    for before in ["", "^", "t", "^th", "tha", "ver", "zzz"]:
        assert abs(sum(plain["en"](c, before) for c in [*signs, "§"]) - 1) < 1e-9


def test_words_share_one_score(spark):
    model = train(table(spark, corpus()))
    texts = ["The river", "the THE the river stone zz", None, "", "12 !", "x" * 3000]
    bits, signs = Scorer(model).texts(texts)
    assert signs.tolist() == [10, 27, 0, 0, 0, 3001]
    each = Scorer(model)
    again = np.array([each.texts([t])[0][0] for t in texts])  # with what it keeps, a text at a time
    assert np.allclose(bits, again, rtol=1e-5)
    codes = np.array([ord(c) for c in "theriverstonezz"])
    words = word_bits(model, codes, np.array([0, 3, 8, 13]), np.array([3, 8, 13, 15]))
    assert np.allclose(bits[1], 3 * words[0] + words[1] + words[2] + words[3], rtol=1e-5)


def test_kept_words_are_bounded(spark, monkeypatch):
    model = train(table(spark, corpus()))
    monkeypatch.setattr(language_id, "KEPT", 4)
    monkeypatch.setattr(language_id, "PIECE", 400)
    texts = [t for _, t, _ in corpus(60, 5)]
    scorer = Scorer(model)
    bits = scorer.texts(texts)[0]
    monkeypatch.undo()
    assert np.allclose(bits, Scorer(model).texts(texts)[0], rtol=1e-5) and len(scorer.known) < 60


def test_held_out_rows(spark):
    rows = corpus(600)
    odd = [(9001, None, "en"), (9002, "", "en"), (9003, "123 — ?!", "de"), (None, "winter garden water", "de"), (9004, "der winter " * 30000 + "the", None), (9005, "中文", "en"), (9006, "hand stone light", None), (9006, "straße über", None)]
    # held-out rows name other languages, which teaches nothing
    lied = [(i, t, lang if teaches(i) else "zz") for i, t, lang in rows]
    found = predict_language(table(spark, [*lied, *odd])).collect()
    assert len(found) == len(rows) + len(odd)
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    right = [by[i][0].lang_pred == lang for i, _, lang in rows if not teaches(i)]
    assert sum(right) == len(right) > 80
    assert all(r.held_out == (not teaches(r.doc_id)) and 0 <= r.score <= 1 for r in found)
    assert {by[i][0].lang_pred for i in (9001, 9002, 9003)} == {"und"} and all(by[i][0].score == 0 and by[i][0].rejected for i in (9001, 9002, 9003))
    assert by[None][0].lang_pred == "en" and by[9004][0].lang_pred == "de" and by[9005][0].lang_pred in WORDS
    assert by[9005][0].score < by[9004][0].score
    assert {r.lang_pred for r in by[9006]} == {"en", "de"}


def test_few_languages_and_none(spark):
    texts = [(1, "some words", None), (2, None, None)]
    assert [(r.lang_pred, r.score, r.rejected) for r in predict_language(table(spark, texts)).collect()] == [("und", 0.0, True)] * 2
    assert predict_language(table(spark, [])).collect() == []
    alone = predict_language(table(spark, [(i, "only words", "en") for i in range(20)])).collect()
    assert {r.lang_pred for r in alone} == {"en"}


def test_a_model_too_large_loses_rare_grams_only(spark, monkeypatch):
    whole = train(table(spark, corpus()))
    size = 2 * sum(len(k) for k in whole.keys) * len(whole.languages)
    monkeypatch.setattr(language_id, "CELLS", size // 2)
    small = train(table(spark, corpus()))
    assert sum(len(k) for k in small.keys) < sum(len(k) for k in whole.keys) and (small.keys[0] == whole.keys[0]).all()
    found = identify(table(spark, corpus(90, 3)), small).collect()
    assert sum(r.lang_pred == list(WORDS)[r.doc_id % 3] for r in found) >= 88


@pytest.mark.parametrize("reject", [0.0, 1.01])
def test_rejection(spark, reject):
    found = identify(table(spark, corpus(30)), train(table(spark, corpus())), reject).collect()
    assert {r.rejected for r in found} == {reject > 1}
