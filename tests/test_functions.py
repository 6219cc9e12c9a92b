"""Every function on its golden cases, one Spark job each."""

import golden
import pytest
from pyspark.sql import functions as F

from lexforge.functions import keys, lexer, ngrams, normalize, phonetics, segments, stemmers, tokenizer
from lexforge.functions.tokenizer import WordTokenizer

CASES = {
    "sentences": (golden.SENTENCES, segments.split_sentences),
    "paragraphs": ({k: v[0] for k, v in golden.PARAGRAPHS.items()}, segments.split_paragraphs),
    "lines": ({k: v[1] for k, v in golden.PARAGRAPHS.items()}, lambda c: segments.split_paragraphs(c, False)),
    "fingerprint": (golden.FINGERPRINTS, keys.fingerprint),
    "unidecode": (golden.UNIDECODE, normalize.unidecode),
    "omission": (golden.OMISSION, keys.omission_key),
    "soundex": (golden.SOUNDEX, phonetics.soundex),
    "refined": (golden.REFINED, phonetics.refined_soundex),
    "phonogram": (golden.PHONOGRAM, phonetics.phonogram),
    "s_stem": (golden.S_STEMS, stemmers.s_stem),
    "porter": (golden.PORTER_STEMS, stemmers.porter_stem),
    "carry": (golden.CARRY_STEMS, stemmers.carry_stem),
    "junk": (golden.JUNK, tokenizer.is_junk),
    "lengthening": (golden.LENGTHENING, normalize.reduce_lengthening),
    "squeeze": (golden.SQUEEZED, normalize.squeeze),
    "measure": (golden.MEASURES, stemmers.measure),
    "hashtags": (golden.HASHTAGS | {k: None for k in golden.NO_HASHTAGS}, lambda c: F.array_join(segments.split_hashtag(c), " ")),
}


def outputs(spark, inputs, f):
    rows = spark.createDataFrame([(x,) for x in inputs], "x string").select("x", f("x").alias("y")).collect()
    return {r.x: r.y for r in rows}


@pytest.mark.parametrize("name", CASES)
def test_golden(spark, name):
    cases, f = CASES[name]
    assert outputs(spark, cases, f) == cases


def test_tokens(spark):
    expected = {text: tokens for _, text, tokens in golden.token_rows()}
    found = outputs(spark, expected, lexer.word_tokens)
    assert {k: [(t.kind, t.text) for t in v] for k, v in found.items()} == expected


def test_texts_with_the_lexers_marks(spark):
    """Noncharacters are punctuation like any other, however many a text has."""
    many = "".join(lexer._SPARE[:90])
    cases = {"a \ufdd1 b": ["a", "\ufdd1", "b"], "\ufdd0x\ufdd1": ["\ufdd0", "x", "\ufdd1"], "\ufdd2 y": ["\ufdd2", "y"], "\ufdd0\ufdd3 z": ["\ufdd0", "\ufdd3", "z"], f"a {many}b": ["a", *many, "b"]}
    found = outputs(spark, cases, lexer.word_tokens)
    assert {k: [t.text for t in v] for k, v in found.items()} == cases
    assert {t.kind for v in found.values() for t in v} == {"word", "punct"}


MEGABYTE = 1 << 20
#: A run of about a megabyte for each alternative of the lexer, and its tokens' number and first kind.
RUNS = {
    "email": ("a@bb.cc" + ".cc" * 200_000, 1, "email"),
    "compound": ("ab-cd_" * (MEGABYTE // 6) + "ab", 1, "word"),
    "compound with apostrophes": ("a-" + "b'c" * (MEGABYTE // 3), 1, "word"),
    "hashtag": ("#a" + "b" * MEGABYTE, 1, "hashtag"),
    "hashtag that ends in a sign": ("#a" + "b" * MEGABYTE + "_", 3, "punct"),
    "mention": ("@a" + "b_" * (MEGABYTE // 2), 1, "mention"),
    "number": ("1" * MEGABYTE + "," + "2" * MEGABYTE, 1, "number"),
    "number with a letter": ("1" * MEGABYTE + "x", 1, "word"),
    "flags": ("\U0001f1eb\U0001f1f7" * (MEGABYTE // 8), 1, "emoji"),
    "joined emoji of two sizes": ("☹\u200d\U0001f466\u200d" * (MEGABYTE // 13) + "☹", 1, "emoji"),
    "url": ("http://" + "a.b/" * (MEGABYTE // 4), 1, "url"),
    "acronym": ("A." * (MEGABYTE // 2), 1, "word"),
    "letters": ("é" * (MEGABYTE // 2), 1, "word"),
    "letters before an apostrophe": ("n" * MEGABYTE + "'x", 3, "word"),
    "contraction": ("a" * MEGABYTE + "n't", 1, "word"),
    "elision": ("l'" + "a" * MEGABYTE, 2, "word"),
    "name": ("O'" + "R" * MEGABYTE, 1, "word"),
    "punctuation": ("!" * 100_000, 100_000, "punct"),
    "blanks": ("a" + " " * MEGABYTE + "b", 2, "word"),
}


def test_long_runs_of_every_alternative(spark, tmp_path):
    path = str(tmp_path / "runs")
    spark.createDataFrame([(k, v[0]) for k, v in RUNS.items()], "name string, x string").repartition(4).write.parquet(path)
    tokens = spark.read.parquet(path).select("name", "x", lexer.word_tokens("x").alias("t"))
    found = tokens.select("name", F.size("t").alias("n"), F.col("t")[0]["kind"].alias("kind"), (F.length(F.array_join(F.transform("t", lambda t: t["text"]), "")) == F.length(F.regexp_replace("x", r"\s", ""))).alias("whole"))
    assert {r.name: (r.n, r.kind, r.whole) for r in found.collect()} == {k: (v[1], v[2], True) for k, v in RUNS.items()}


def test_line_ends_in_words(spark):
    assert outputs(spark, ["a\rties", "a\x85cats"], stemmers.porter_stem) == {"a\rties": "a\rti", "a\x85cats": "a\x85cat"}


def test_null_texts(spark):
    row = spark.createDataFrame([(None,)], "x string").select(
        *[f("x").alias(name) for name, (_, f) in CASES.items()], lexer.word_tokens("x").alias("tokens")
    )
    assert all(v is None for v in row.first())


def texts(spark, tokens):
    return lambda text: [t.text for t in outputs(spark, [text], tokens)[text]]


def test_tokenizer_options(spark):
    plain = WordTokenizer()
    assert texts(spark, plain.insert_stopword("le").insert_stopword("la").insert_stopword("").tokenize)("Le chat mange la souris leb") == ["chat", "mange", "souris", "leb"]
    assert texts(spark, plain.stopwords(["chat", "souris"]).tokenize)("le chat mange la souris") == ["le", "mange", "la"]
    assert texts(spark, plain.kind_blacklist(["number"]).tokenize)("1 chat ⭐️") == ["chat", "⭐️"]
    assert texts(spark, plain.kind_whitelist(["number", "emoji"]).tokenize)("1 chat ⭐️") == ["1", "⭐️"]
    assert texts(spark, plain.kind_blacklist(["word"]).kind_blacklist(["number"]).tokenize)("1 chat") == ["chat"]
    assert texts(spark, plain.min_token_chars(3).tokenize)("C’est bien!") == ["est", "bien"]
    assert texts(spark, plain.max_token_chars(2).tokenize)("le chat") == ["le"]
    assert texts(spark, plain.filter_junk().tokenize)("le chat oufehfhhhhhhhh") == ["le", "chat"]
    assert texts(spark, plain.simple_tokenize)("le chat un 2") == ["le", "chat", "un", "2"]


def test_bad_options():
    with pytest.raises(ValueError, match="unknown word token kind"):
        WordTokenizer().kind_blacklist(["smiley"])
    for call in (lambda: ngrams.ngrams("x", 0), lambda: ngrams.ngrams_range("x", 0, 2), lambda: ngrams.ngrams_range("x", 3, 2)):
        with pytest.raises(ValueError):
            call()


def test_vowels(spark):
    assert outputs(spark, ["à", "A", "f", "F"], tokenizer.starts_with_vowel) == {"à": True, "A": True, "f": False, "F": False}


WORDS = ["the", "cat", "eats", "the", "mouse"]


def grams(spark, words, make):
    return spark.createDataFrame([(words,)], "x array<string>").select(make("x").alias("y")).first().y


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9])
def test_ngrams(spark, n):
    expected = [WORDS[i : i + n] for i in range(max(1, len(WORDS) - n + 1))]
    assert grams(spark, WORDS, lambda c: ngrams.ngrams(c, n)) == expected
    assert grams(spark, WORDS, lambda c: ngrams.ngrams_range(c, n, n)) == expected
    assert grams(spark, [], lambda c: ngrams.ngrams(c, n)) == []


def test_ngrams_range(spark):
    found = [" ".join(g) for g in grams(spark, WORDS, lambda c: ngrams.ngrams_range(c, 1, 4))]
    assert found == [
        "the", "cat", "eats", "the", "the cat", "cat eats", "eats the", "the cat eats", "cat eats the", "the cat eats the",
        "mouse", "the mouse", "eats the mouse", "cat eats the mouse",
    ]
    two = ["the", "cat"]
    assert grams(spark, two, lambda c: ngrams.ngrams_range(c, 1, 3)) == [["the"], ["cat"], two]
    assert grams(spark, two, lambda c: ngrams.ngrams_range(c, 4, 5)) == [two]
    assert grams(spark, [], lambda c: ngrams.ngrams_range(c, 1, 5)) == []


def test_ngram_counts(spark):
    row = spark.range(1).select(
        ngrams.ngrams_len(F.lit(5), 2).alias("a"), ngrams.ngrams_len(F.lit(4), 5).alias("b"), ngrams.ngrams_len(F.lit(2), 5).alias("c"),
        ngrams.ngrams_len(F.lit(0), 2).alias("d"), ngrams.ngrams_range_len(F.lit(5), 1, 4).alias("e"), ngrams.ngrams_range_len(F.lit(2), 4, 5).alias("f"),
        ngrams.ngrams_range_len(F.lit(2), 1, 4).alias("g"),
    ).first()
    assert list(row) == [4, 0, 1, 0, 14, 1, 4]


def test_homophones(spark):
    for names in golden.HOMOPHONES:
        assert len(set(outputs(spark, names, phonetics.refined_soundex).values())) == 1


def test_token_helpers(spark):
    row = spark.range(1).select(lexer.token_pair(lexer.token_struct(F.lit("a"), "url")).alias("p")).first()
    assert tuple(row.p) == ("a", "url")


def test_long_texts(spark):
    long = {"a" * 100_000: 1, "a-" * 50_000 + "a": 1, "x. " * 20_000: 1}
    found = outputs(spark, long, lambda c: F.size(lexer.word_tokens(c)))
    assert sorted(found.values()) == [1, 1, 40_000]
    assert outputs(spark, ["Ok then. " * 3_000], lambda c: F.size(segments.split_sentences(c)))["Ok then. " * 3_000] == 3_000


def test_old_quotes_are_forgotten(spark):
    text = 'He said "' + "word " * 80 + "here stop. Then it ended. So it did. " + "More words follow now. " * 20
    found = outputs(spark, [text], segments.split_sentences)[text]
    assert len(found) > 10 and " ".join(found) == text.strip()
