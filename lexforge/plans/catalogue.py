"""The registered queries for the text operators, and their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import keys, ngrams, normalize, phonetics, segments, stemmers
from lexforge.functions.lexer import KINDS, parsed_kind, simple_tokens, token_pair, token_struct, word_tokens
from lexforge.functions.tokenizer import WordTokenizer, is_junk, starts_with_vowel
from lexforge.operators import tables
from lexforge.plans import oracles
from lexforge.sources import names

STOPWORDS = ("the", "of", "and", "de", "la", "der", "die", "que", "en")

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokens(tokenizer: WordTokenizer | None = None, simple: bool = False) -> Query:
    return lambda spark, d: tables.explode_tokens(_table(spark, d, "documents"), tokenizer=tokenizer, simple=simple)


def _counted(query: Query, *by: str) -> Query:
    return lambda spark, d: query(spark, d).groupBy(*by).agg(F.count("*").alias("n"))


def _words(name: str, f: Callable[[str], Column]) -> Query:
    """A function of words over the vocabulary of the documents."""
    return lambda spark, d: tables.vocabulary(_table(spark, d, "documents")).select("word", f("word").alias(name))


def _texts(name: str, f: Callable[[str], Column]) -> Query:
    return lambda spark, d: _table(spark, d, "documents").select("doc_id", f("text").alias(name))


def _parts(name: str, f: Callable[[str], Column]) -> Query:
    return lambda spark, d: _table(spark, d, "part").select("p_partkey", f("p_name").alias(name))


def _grams(make: Callable[[Column], Column]) -> Query:
    """Grams of the words of part names, a row each."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        grams = F.transform(make(F.split("p_name", " ")), lambda g: F.array_join(g, " "))
        return _table(spark, d, "part").select("p_partkey", F.posexplode(grams).alias("pos", "gram"))

    return query


def _lens(spark: SparkSession, d: str) -> DataFrame:
    size = F.size(F.split("p_name", " "))
    some = {f"n{n}": ngrams.ngrams_len(size, n) for n in (1, 2, 5, 6, 9)} | {"r1_4": ngrams.ngrams_range_len(size, 1, 4), "r7_8": ngrams.ngrams_range_len(size, 7, 8)}
    return _table(spark, d, "part").select("p_partkey", *[c.cast("long").alias(k) for k, c in some.items()])


def _shared_folder(spark: SparkSession) -> str:
    """What all executors see: the folder of checkpoints. A local session without one gets a temporary folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return named or tempfile.gettempdir()


def _token_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents as tokens made by hand, as (text, kind)."""
    words = _tokens(simple=True)(spark, d)
    return words.select("doc_id", "pos", token_pair(token_struct("text", "word")).alias("p")).select("doc_id", "pos", F.col("p.text").alias("text"), F.col("p.kind").alias("kind"))


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    """Strings that are names of kinds, and others."""
    names_ = spark.createDataFrame([(k,) for k in [*KINDS, "Word", "", "smiley"]], "input string").union(_table(spark, d, "conversations").select("role"))
    return names_.distinct().select("input", parsed_kind("input").alias("kind"))


def _hashtags(spark: SparkSession, d: str) -> DataFrame:
    """Hashtags made of every four words of a document, capitals first, with their number between, and their parts."""
    words = _table(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    groups = words.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 4).cast("int")), lambda i: F.slice("w", i * 4 + 1, 4))).alias("tag", "g"))
    word = lambda i: F.initcap(F.get(F.col("g"), F.lit(i)))
    tags = groups.select("doc_id", "tag", F.concat(F.lit("#"), F.concat_ws("", word(0), word(1), F.col("tag").cast("string"), word(2), word(3))).alias("text"))
    return tags.select("doc_id", "tag", F.posexplode(segments.split_hashtag("text")).alias("pos", "part"))


def _spaced_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of documents in which a blank line follows each sentence and what comes next is indented."""
    spaced = F.regexp_replace("text", r"\. ", ".\n \t\n  ")
    return tables.explode_paragraphs(_table(spark, d, "documents").select("doc_id", spaced.alias("text")))


def _doc_grams(spark: SparkSession, d: str) -> DataFrame:
    """How often each two-word gram of whole documents occurs."""
    words = F.transform(simple_tokens("text"), lambda t: t["text"])
    grams = _table(spark, d, "documents").select(F.explode(F.transform(ngrams.ngrams(words, 2), lambda g: F.array_join(g, " "))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


#: What the documents' words, one after another, are made into to reach all rules of the lexer.
MADE = (
    "w", "'l\\'a' || w", "w || 'n\\'t'", "'#ab' || w", "'@ab' || w", "'https://ab.cd/' || w || '?q=1.'", "w || '@mail.example.com'", "'🙂' || w",
    "w || '\\'s'", "'o\\'b' || w", "w || '-' || w", "w || '-je'", "i || ',' || length(w)", "'Mr. ' || w", "'A.B. ' || w", "'$ab' || w", "'\\'tis'",
    "w || '!?'", "'(' || w || ')'", "w || '_' || w", "'👍🏾 🇫🇷'", "'-' || i || ' -' || w", "w || i || 'º'", "'d’é' || w",
)


def _marked_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of texts whose words are made into elisions, contractions, tags, addresses, emoji and compounds."""
    words = F.regexp_extract_all("text", F.lit("[a-z]{3,}"), F.lit(0))
    made = F.expr(f"transform(words, (w, i) -> CASE i % {len(MADE)} {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(MADE))} END)")
    texts = _table(spark, d, "documents").select("doc_id", words.alias("words")).select("doc_id", F.array_join(made, " ").alias("text"))
    return tables.explode_tokens(texts)


#: How the letters a to z are written in other scripts, to make words of these from words of the documents.
SCRIPTS = {
    "georgian": "ა ბ ც დ ე ფ გ ჰ ი ჯ კ ლ მ ნ ო პ ყ რ ს ტ უ ვ წ ხ ღ ზ",
    "armenian": "Ա բ ց դ ե ֆ գ հ ի ջ կ լ մ ն օ պ ք ր ս տ ու վ ւ խ յ Զ",
    "hebrew": "א ב צ ד ע פ ג ה י ז כ ל מ נ ו ף ק ר ס ט ו ו ש ח י ז",
    "arabic": "ا ب چ د ي ف گ ه ي ج ك ل م ن و پ ق ر س ت و ث و خ ي ز",
    "hiragana": "あ ば ちゃ だ え ふ ぎょ は い じゅ っか る ま ん お っぷ くぇ り しゃ った う ゔぁ わ っち や ぜ",
    "katakana": "ア ビ チェ デュ エ ファ グ ヘ イ ジョ キュ ー ミ ナ ヲ ッポ トゥ ロ シュ ティ ズ ヴィ ウィ ッサ ユ ツ",
}


def _in_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Words of the documents as other scripts write them, each in one script, and their codes."""
    letter = lambda c: F.element_at(F.split(F.lit("|".join(SCRIPTS.values())), r"\|")[F.col("k")], 1)  # noqa: E731, F841
    rows = F.split(F.lit("|".join(SCRIPTS.values())), r"\|")
    names_ = F.split(F.lit(" ".join(SCRIPTS)), " ")
    words = tables.vocabulary(_table(spark, d, "documents")).where(F.col("word").rlike(r"^[a-z]+\z"))
    placed = words.withColumn("k", (F.length("word") + F.ascii("word")) % len(SCRIPTS)).withColumn("signs", F.split(F.element_at(rows, F.col("k") + 1), " "))
    written = placed.select("word", F.element_at(names_, F.col("k") + 1).alias("script"), F.array_join(F.transform(F.split("word", ""), lambda c: F.element_at(F.col("signs"), F.ascii(c) - 96)), "").alias("written"))
    codes = {"ascii": normalize.unidecode, "omission_key": keys.omission_key, "soundex": phonetics.soundex, "refined_soundex": phonetics.refined_soundex, "phonogram": phonetics.phonogram}
    return written.select("word", "script", *[f("written").alias(k) for k, f in codes.items()])


def _hangul(spark: SparkSession, d: str) -> DataFrame:
    """Names of three Hangul syllables, made of the numbers of parts, and their codes."""
    code = lambda i: F.lit(0xAC00) + (F.col("p_partkey") * 7919 + i * 613) % 11172
    utf8 = lambda c: F.lit(0xE08080) + F.shiftleft(F.shiftright(c, 12), 16) + F.shiftleft(F.shiftright(c, 6).bitwiseAND(63), 8) + c.bitwiseAND(63)
    name = F.concat(*[F.decode(F.unhex(F.hex(utf8(code(i)))), "UTF-8") for i in range(3)])
    written = _table(spark, d, "part").select("p_partkey", name.alias("name"))
    codes = {"ascii": normalize.unidecode, "omission_key": keys.omission_key, "soundex": phonetics.soundex, "refined_soundex": phonetics.refined_soundex}
    return written.select("p_partkey", *[f("name").alias(k) for k, f in codes.items()])


def _range_rows(spark: SparkSession, d: str) -> DataFrame:
    """Grams of two and three words of whole documents, a row each."""
    words = F.transform(simple_tokens("text"), lambda t: t["text"])
    return tables.explode_ngrams(_table(spark, d, "documents"), words, 2, 3).select("doc_id", "pos", F.array_join("gram", " ").alias("gram"))


#: So many numbers are in the stoplist of ``tokens_large_stoplist`` besides words of the tables.
NUMBERS = 1_000_000


def _large_stoplist(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents without those of the benchmark's items and the names of parts, nor any number below a million."""
    known = _table(spark, d, "benchmark").select("text").union(_table(spark, d, "part").select("p_name"))
    stoplist = tables.vocabulary(known).union(spark.range(NUMBERS).select(F.col("id").cast("string")))
    return _counted(lambda *_: tables.without_stopwords(_tokens(simple=True)(spark, d), stoplist), "doc_id")(spark, d)


def _coded_tokens(spark: SparkSession, d: str) -> DataFrame:
    """How many words of each document have each phonetic code, each word coded once."""
    words = _tokens(simple=True)(spark, d).select("doc_id", "text")
    return tables.per_word(words, "text", "code", phonetics.soundex).groupBy("doc_id", "code").agg(F.count("*").alias("n"))


def _csv(spark: SparkSession, d: str) -> DataFrame:
    """Part names through a CSV file and back."""
    path = f"{_shared_folder(spark)}/names-{uuid.uuid4().hex}"
    _table(spark, d, "part").select("p_name", F.col("p_partkey").cast("string").alias("p_partkey")).write.option("header", True).mode("overwrite").csv(f"{path}-in")
    names.encode_csv(spark, f"{path}-in", f"{path}-out")
    return names.read_csv(spark, f"{path}-out")


def _pipeline(spark: SparkSession, d: str) -> DataFrame:
    return tables.segmented(_table(spark, d, "documents")).groupBy("doc_id", "par", "sent").agg(F.count("*").alias("n_tokens"))


_PLAIN = WordTokenizer()

QUERIES: dict[str, Query] = {
    "simple_tokens": _tokens(simple=True),
    "simple_token_counts": _counted(_tokens(WordTokenizer().stopwords(STOPWORDS).min_token_chars(3), simple=True), "text"),
    "word_tokens_docs": _tokens(),
    "token_kind_counts": _counted(_tokens(), "kind"),
    "tokens_blacklist": _counted(_tokens(_PLAIN.kind_blacklist(["punct", "number"])), "doc_id"),
    "tokens_whitelist": _counted(_tokens(_PLAIN.kind_whitelist(["number", "mention"])), "kind", "text"),
    "tokens_min_max": _counted(_tokens(_PLAIN.min_token_chars(4).max_token_chars(7)), "doc_id"),
    "tokens_stopwords": _counted(_tokens(_PLAIN.stopwords(STOPWORDS)), "doc_id"),
    "tokens_insert_stopword": _counted(_tokens(WordTokenizer().insert_stopword("the").insert_stopword("").insert_stopword("Que"), simple=True), "doc_id"),
    "token_pairs": _token_pairs,
    "token_kinds": _kinds,
    "tokens_marked_docs": _marked_tokens,
    "hashtag_parts_docs": _hashtags,
    "ngrams_docs_2": _doc_grams,
    "tokens_no_junk": _counted(_tokens(_PLAIN.filter_junk()), "doc_id"),
    "junk_words": lambda spark, d: tables.vocabulary(_table(spark, d, "documents")).select("word", is_junk("word").alias("junk"), starts_with_vowel("word").alias("vowel")),
    "ngrams_2": _grams(lambda t: ngrams.ngrams(t, 2)),
    "ngrams_3": _grams(lambda t: ngrams.ngrams(t, 3)),
    "ngrams_short": _grams(lambda t: ngrams.ngrams(t, 9)),
    "ngrams_range_1_3": _grams(lambda t: ngrams.ngrams_range(t, 1, 3)),
    "ngrams_len": _lens,
    "paragraphs": lambda spark, d: tables.explode_paragraphs(_table(spark, d, "documents")),
    "paragraphs_spaced_docs": _spaced_paragraphs,
    "paragraphs_lines": lambda spark, d: tables.explode_paragraphs(_table(spark, d, "documents"), aerated=False),
    "sentences": lambda spark, d: tables.explode_sentences(_table(spark, d, "documents")),
    "fingerprint_key": _parts("fingerprint", keys.fingerprint),
    "fingerprint_tokens": lambda spark, d: _table(spark, d, "documents").select("doc_id", F.posexplode(keys.fingerprint_tokens("text")).alias("pos", "token")),
    "omission_key": _words("omission_key", keys.omission_key),
    "soundex": _words("soundex", phonetics.soundex),
    "refined_soundex": _words("refined_soundex", phonetics.refined_soundex),
    "phonogram": _words("phonogram", phonetics.phonogram),
    "csv_phonogram_roundtrip": _csv,
    "names_phonogram": lambda spark, d: names.encode_names(spark, _table(spark, d, "part").select("p_name")),
    "s_stem": _words("stem", stemmers.s_stem),
    "porter_stem": _words("stem", stemmers.porter_stem),
    "carry_stem": _words("stem", stemmers.carry_stem),
    "stem_measure": _words("measure", lambda c: stemmers.measure(c).cast("long")),
    "squeeze": _texts("squeezed", normalize.squeeze),
    "reduce_lengthening": _texts("reduced", normalize.reduce_lengthening),
    "unidecode": _words("ascii", normalize.unidecode),
    "codes_of_scripts": _in_scripts,
    "soundex_tokens": _coded_tokens,
    "tokens_large_stoplist": _large_stoplist,
    "ngrams_range_docs": _range_rows,
    "codes_of_hangul": _hangul,
    "doc_pipeline": _pipeline,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql(STOPWORDS)
