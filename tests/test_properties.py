"""Properties of the functions on generated texts: all texts of a run go through one job."""

import math
import random
import re
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexforge.functions import keys, lexer, normalize, segments
from lexforge.functions.tokenizer import WordTokenizer
from lexforge.operators import tables

LIMITS = settings(max_examples=4, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
CHARS = st.text(alphabet="abcéÉABC 0123.,;!?'’-_#@$€«»()\"\n\t🙏⭐️ñ中", max_size=60)
TEXTS = st.lists(CHARS, min_size=40, max_size=60)


@LIMITS
@given(TEXTS)
def test_tokens_cover_the_text_in_order(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for row in df.select("x", lexer.word_tokens("x").alias("t")).collect():
        at = 0
        for token in row.t:
            found = row.x.index(token.text, at)
            # between tokens there is nothing but blanks and the hyphens of split compounds
            assert not row.x[at:found].strip(" \n\t-")
            at = found + len(token.text)
        assert not row.x[at:].strip()


@LIMITS
@given(TEXTS)
def test_clean_up(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    once = normalize.squeeze("x")
    row = df.select(
        F.min(normalize.squeeze(once) == once).alias("squeeze"),
        F.min(keys.fingerprint(keys.fingerprint("x")) == keys.fingerprint("x")).alias("fingerprint"),
        F.min(~normalize.unidecode("x").rlike(r"[^\x00-\x7F]")).alias("ascii"),
    ).first()
    assert all(row)


@LIMITS
@given(TEXTS)
def test_stopwords_never_survive(spark, texts):
    kept = WordTokenizer().stopwords(["a", "É"]).tokenize("x")
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert not df.select(F.explode(kept).alias("t")).where(F.lower("t.text").isin("a", "é")).count()


@LIMITS
@given(TEXTS)
def test_sentences_keep_all_but_blanks(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for row in df.select("x", segments.split_sentences("x").alias("s")).collect():
        assert "".join("".join(row.s).split()) == "".join(row.x.split())


CLOSING = r"[.?!…]+(?:\s[.?!…])*[«»„‟“”\")}\]]?\s+"
ABBREVIATION = re.compile(r"\b(?:[A-Z0-9]\s*|prof|me?lle|mgr|mrs|mme?|[djms]r|st|etc|ms?|pp?)\Z", re.IGNORECASE)


def plain_sentences(text):
    """Sentences by a loop over the places where one may end."""
    done, now = [], ""
    for found in re.finditer(rf"(?s).*?{CLOSING}|.+", text):
        part = found.group()
        if not now:
            part = re.sub(r"\A[\x00-\x1f\s]+", "", part)
        raw = now.encode()
        cut = max(0, len(raw) - 256)
        while cut and raw[cut] & 0xC0 == 0x80:
            cut -= 1
        window = raw[cut:].decode() + part
        now += part
        before = re.sub(rf"{CLOSING}\Z", "", window)
        quotes, brackets = (sum(window.count(c) for c in some) % 2 for some in ("«»„‟“”\"", "(){}[]"))
        if before != window and not ABBREVIATION.search(before) and not quotes and not (brackets and not re.match(r"[A-Z0-9]\)", window)):
            done.append(now.rstrip())
            now = ""
    return [*done, now.rstrip()] if now else done


def prose():
    draw = random.Random(11)
    words = ["Mr", "etc", "Prof", "A", "3", "(see", "that)", "\"so", "so\"", "été", "«ñ»", "中文", "word", "St", "B)", "end", "", "pp", "[x]"]
    ends = [" ", " ", " ", ". ", "! ", "?! ", "… ", ".\n", ". . ", ".) ", ".\" ", ".", "\n", "\n\n", "\t"]
    short = ["".join(draw.choice(words) + draw.choice(ends) for _ in range(draw.randint(0, 40))) for _ in range(300)]
    # an open quote leaves the context after 256 bytes, in the middle of a character too
    return [*short, *(f"\"{'é' * n} one. Two. Three. {'w ' * 90}four. Five." for n in range(100, 134)), "", " \n "]


def test_sentences_against_a_plain_loop(spark):
    df = spark.createDataFrame([(t,) for t in prose()], "x string")
    for row in df.select("x", segments.split_sentences("x").alias("s")).collect():
        assert row.s == plain_sentences(row.x), row.x


def test_segments_against_plain_loops(spark):
    texts = prose()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.par, r.sent): r["count"] for r in tables.segmented(df).groupBy("doc_id", "par", "sent").count().collect()}
    cut = [(i, k, m, s) for i, t in enumerate(texts) for k, p in enumerate(re.split(r"(?:\n\r|\r\n|\r|\n)[\t\s]*(?:\n\r|\r\n|\r|\n)*", t)) for m, s in enumerate(plain_sentences(p))]
    sentences = spark.createDataFrame(cut, "doc_id long, par int, sent int, x string")
    sizes = {(r.doc_id, r.par, r.sent): r.n for r in sentences.select("doc_id", "par", "sent", F.size(lexer.word_tokens("x")).alias("n")).where("n > 0").collect()}
    assert found == sizes


def test_marks_apart_from_others(spark):
    """A mark that follows a mark and a blank may be the next sentence's."""
    cases = {"Hello. .NET is nice.": ["Hello.", ".NET is nice."], "So . . . yes. No": ["So . . .", "yes.", "No"], "End.. .. ..x": ["End..", "..", "..x"], "Oh?!... ok": ["Oh?!...", "ok"]}
    df = spark.createDataFrame([(t,) for t in cases], "x string")
    assert {r.x: r.s for r in df.select("x", segments.split_sentences("x").alias("s")).collect()} == cases
    assert {t: plain_sentences(t) for t in cases} == cases


def test_sentences_take_time_in_proportion(spark):
    """Twice as many sentences, or a megabyte of marks, cost about twice as much and no more."""

    def seconds(text):
        df = spark.createDataFrame([(text,)], "x string").cache()
        df.count()
        best = math.inf
        for _ in range(3):
            began = time.perf_counter()
            n = df.select(F.size(segments.split_sentences("x")).alias("n")).first().n
            best = min(best, time.perf_counter() - began)
        return n, best

    short, long = "It rains (a bit). ", "He said: \"no end. Go on. "
    seconds(short * 2000)
    small, large = seconds(short * 40_000), seconds(short * 80_000)
    assert (small[0], large[0]) == (40_000, 80_000) and large[1] <= 2 * small[1] + 0.5
    assert seconds(long * 20_000)[1] < 20  # sentences that hardly end
    assert seconds("." * 1_000_000)[1] < 5 and seconds(". " * 500_000 + "x")[1] < 5 and seconds("x" + " " * 1_000_000 + "y")[1] < 5
