"""DataFrame operators: a row per token, gram, paragraph or sentence, work done once per word, and large stoplists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.lexer import simple_tokens
from lexforge.functions.ngrams import checked_sizes
from lexforge.functions.segments import split_paragraphs, split_sentences
from lexforge.functions.tokenizer import WordTokenizer


def unused(names: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def exploded(df: DataFrame, items: Column, keys: list[str], position: str, name: str) -> DataFrame:
    """A row per item of an array: keys, position from 0, item. Only the keys go along."""
    return df.select(*keys, F.posexplode(items).alias(position, name))


def explode_tokens(df: DataFrame, text: str = "text", keys: list[str] | None = None, tokenizer: WordTokenizer | None = None, simple: bool = False) -> DataFrame:
    """keys, pos, kind, text for each token that the tokenizer keeps."""
    tokenizer, keys = tokenizer or WordTokenizer(), keys if keys is not None else ["doc_id"]
    tokens = (tokenizer.simple_tokenize if simple else tokenizer.tokenize)(F.col(text))
    return exploded(df, tokens, keys, "pos", "token").select(*keys, "pos", F.col("token.kind").alias("kind"), F.col("token.text").alias("text"))


def explode_paragraphs(df: DataFrame, text: str = "text", keys: list[str] | None = None, aerated: bool = True) -> DataFrame:
    return exploded(df, split_paragraphs(text, aerated), keys if keys is not None else ["doc_id"], "par", "paragraph")


def explode_sentences(df: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    return exploded(df, split_sentences(text), keys if keys is not None else ["doc_id"], "sent", "sentence")


def segmented(df: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: WordTokenizer | None = None) -> DataFrame:
    """key, par, sent, pos, kind, text: documents to paragraphs to sentences to tokens."""
    paragraphs = explode_paragraphs(df, text, [key], aerated=False)
    sentences = explode_sentences(paragraphs, "paragraph", [key, "par"])
    return explode_tokens(sentences, "sentence", [key, "par", "sent"], tokenizer)


def explode_ngrams(df: DataFrame, words: Column, low: int, high: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """keys, pos, gram for each gram of ``ngrams_range`` (of ``ngrams`` without ``high``), in the same order.

    Places and sizes are generated and each gram is sliced for its own row, so no value holds all
    grams of a text. ``pos`` is computed from the place: before the gram that ends at item j in a
    text of more than ``high`` items come all grams of the first ``high`` items.
    """
    high, keys = low if high is None else high, keys if keys is not None else ["doc_id"]
    checked_sizes(low, high)
    items, least, head, end, size = unused(keys, "_items", "_least", "_head", "_end", "_size")
    length = F.size(items)
    rows = df.select(*keys, words.alias(items)).where(length > 0)
    rows = rows.withColumns({least: F.least(F.lit(low), length), head: F.least(F.lit(high), length)})
    ends = rows.select("*", F.explode(F.sequence(F.col(least), length)).alias(end))
    sizes = ends.select("*", F.explode(F.sequence(F.col(least), F.least(F.lit(high), F.col(end)))).alias(size))
    a, b, j, n = (F.col(c).cast("long") for c in (least, head, end, size))
    before = (n - a) * (b + 1) - (n * (n - 1) - a * (a - 1)) / 2  # of the first items' grams, those of fewer items
    all_first = (b - a + 1) * (b + 1) - (b * (b + 1) - a * (a - 1)) / 2
    place = F.when(j <= b, before + j - n).otherwise(all_first + (j - b - 1) * (b - a + 1) + n - a)
    return sizes.select(*keys, place.cast("long").alias("pos"), F.slice(items, F.col(end) - F.col(size) + 1, F.col(size)).alias("gram"))


def vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """The distinct words of a table, in one column ``word``; partial distincts come before the shuffle."""
    return df.select(F.explode(F.transform(simple_tokens(F.col(text)), lambda t: t["text"])).alias("word")).distinct()


#: A word with more rows than this, and than its share of all, is frequent: fewer than FREQUENT_WORDS are, of FREQUENT_BYTES in all.
FREQUENT_ROWS, FREQUENT_WORDS, FREQUENT_BYTES = 10_000, 10_000, 8 << 20


def per_word(words: DataFrame, column: str, out: str, f: Callable[[str], Column]) -> DataFrame:
    """Add ``out`` = f(column), computed once for each distinct word and joined back.

    Frequent words, and null, are sent to all tasks, as few as their least count allows and of a
    checked size; the rest are joined by a shuffle, in which rows of frequent words are dealt
    evenly, so no task gets all rows of a word.
    """
    word, value, found, n, part, key, rest_part = unused([*words.columns, out], "_word", "_value", "_found", "_n", "_part", "_key", "_rest")
    counted = words.groupBy(F.col(column).alias(word)).agg(F.count("*").alias(n))
    total, longest = counted.agg(F.sum(n), F.max(F.octet_length(word))).first()
    most = max(1, min(FREQUENT_WORDS, FREQUENT_BYTES // (longest or 1)))
    frequent = (F.col(n) > max(FREQUENT_ROWS, (total or 0) // most)) | F.col(word).isNull()
    known = counted.withColumn(value, f(word))
    few = known.where(frequent).select(word, F.col(value).alias(found), F.lit(True).alias(n))
    marked = words.join(F.broadcast(few), F.col(column).eqNullSafe(F.col(word)), "left").withColumn(part, F.when(F.col(n), F.spark_partition_id()).otherwise(-1)).drop(word)
    rest = known.where(~frequent).select(word, value, F.lit(-1).alias(rest_part))
    joined = marked.withColumn(key, F.when(F.col(n), F.lit("")).otherwise(F.col(column))).join(rest, (F.col(key) == F.col(word)) & (F.col(part) == F.col(rest_part)), "left")
    return joined.select(*words.columns, F.when(F.col(n), F.col(found)).otherwise(F.col(value)).alias(out))


#: A stoplist of more bytes than this is not sent to all tasks; a filter of its words, of at most so many bits, is.
STOPLIST_BYTES, FILTER_BITS, FILTER_HASHES = 4 << 20, 1 << 26, 4


def without_stopwords(tokens: DataFrame, stoplist: DataFrame, text: str = "text", word: str | None = None, broadcast_bytes: int = STOPLIST_BYTES) -> DataFrame:
    """The tokens that are no word of ``stoplist``, whole and in any case; null tokens stay, null and empty words stop nothing.

    ``word`` names the stoplist's column, else it is the first. A small stoplist goes to all tasks.
    Of a large one they get a Bloom filter, whose size follows the number of words up to a bound;
    only tokens that it may hold are shuffled to an anti join, which decides.
    """
    stop = unused(tokens.columns, "_stop")[0]
    words = stoplist.select(F.lower(F.col(word or stoplist.columns[0])).alias(stop)).where(F.col(stop) != "").distinct()
    count, size = words.agg(F.count("*"), F.sum(F.octet_length(stop) + 16)).first()
    same = F.lower(F.col(text)) == F.col(stop)
    if not count:
        return tokens
    if size <= broadcast_bytes:
        return tokens.join(F.broadcast(words), same, "left_anti")
    bits = min(FILTER_BITS, 1 << (16 * count - 1).bit_length())
    maybe = F.coalesce(_may_hold(_filter(words, stop, bits).scalar(), F.lower(F.col(text)), bits), F.lit(False))
    return tokens.where(~maybe).union(tokens.where(maybe).join(words, same, "left_anti"))


def _places(word: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(word, F.lit(k)), F.lit(bits).cast("long")) for k in range(FILTER_HASHES)]


def _filter(words: DataFrame, column: str, bits: int) -> DataFrame:
    """One row: the filter's bits as an array of 64-bit numbers."""
    set_ = words.select(F.explode(F.array(*_places(F.col(column), bits))).alias("p"))
    cells = set_.select(F.shiftright("p", 6).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(63).cast("int")).alias("bits"))
    every = cells.union(words.sparkSession.range(bits // 64).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("bits")))
    merged = every.groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    return merged.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "bits"))), lambda s: s["bits"]).alias("bits"))


def _may_hold(cells: Column, word: Column, bits: int) -> Column:
    hits = [F.getbit(F.element_at(cells, (F.shiftright(p, 6) + 1).cast("int")), p.bitwiseAND(63).cast("int")) == 1 for p in _places(word, bits)]
    return hits[0] & hits[1] & hits[2] & hits[3]
