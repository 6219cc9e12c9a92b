"""DataFrame operators, files and streams."""

import csv
import glob

import pytest
from pyspark.sql import functions as F

from lexforge.functions import ngrams, phonetics
from lexforge.operators import tables
from lexforge.sources import names
from lexforge.streaming import tokens

ROWS = [(1, "Hello there. Bye!\n\nNew one.", "x"), (2, None, "y"), (3, "", "z"), (3, "again", "z")]


def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, pos string")


def test_rows_of_tokens(spark):
    found = tables.explode_tokens(docs(spark).drop("pos")).where("doc_id = 1").orderBy("pos").collect()
    assert [(r.pos, r.kind, r.text) for r in found][:3] == [(0, "word", "Hello"), (1, "word", "there"), (2, "punct", ".")]


def test_keys_that_clash_are_the_callers(spark):
    assert tables.explode_sentences(docs(spark)).columns == ["doc_id", "sent", "sentence"]


def test_segments(spark):
    found = tables.segmented(docs(spark)).groupBy("doc_id", "par", "sent").count().orderBy("doc_id", "par", "sent").collect()
    assert [tuple(r) for r in found] == [(1, 0, 0, 3), (1, 0, 1, 2), (1, 1, 0, 3), (3, 0, 0, 1)]


def test_vocabulary_and_work_per_word(spark):
    words = tables.vocabulary(docs(spark))
    assert {r.word for r in words.collect()} == {"Hello", "there", "Bye", "New", "one", "again"}
    df = spark.createDataFrame([("Rupert", 1), ("Rupert", 2), (None, 3)], "word string, n int")
    found = tables.per_word(df, "word", "code", phonetics.soundex).orderBy("n").collect()
    assert [tuple(r) for r in found] == [("Rupert", 1, "R163"), ("Rupert", 2, "R163"), (None, 3, None)]


def test_a_frequent_word_is_no_single_task(spark, monkeypatch):
    """Half of all rows have one word and some have none; each word is coded once and no task joins much more than others."""
    monkeypatch.setattr(tables, "FREQUENT_ROWS", 1000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = F.col("id")
        word = F.when(n % 2 == 0, "the").when(n % 11 == 1, None).otherwise(F.concat(F.lit("w"), (n % 4001).cast("string")))
        df = spark.range(0, 80_000, 1, 16).select(word.alias("word"), n.alias("_key"), (n % 3).alias("_word"))
        found = tables.per_word(df, "word", "code", lambda c: F.coalesce(F.upper(F.col(c) if isinstance(c, str) else c), F.lit("?")))
        assert found.columns == ["word", "_key", "_word", "code"]
        sizes = sorted(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 80_000 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
        assert found.where("not (code <=> coalesce(upper(word), '?'))").count() == 0 and found.select("_key").distinct().count() == 80_000
    finally:
        for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_long_and_no_words(spark, monkeypatch):
    monkeypatch.setattr(tables, "FREQUENT_ROWS", 1)
    df = spark.createDataFrame([("x" * 3_000_000,), ("x" * 3_000_000,), ("a",), ("a",), (None,), ("",)], "word string")
    assert sorted(r.n or -1 for r in tables.per_word(df, "word", "n", F.length).collect()) == [-1, -1, 1, 1, 3_000_000, 3_000_000]
    assert tables.per_word(df.limit(0), "word", "n", F.length).collect() == []


def test_stoplists_of_any_size(spark):
    tokens = spark.createDataFrame([(i, t) for i, t in enumerate(["The", "the", "cat", None, "ÉTÉ", "w17", "", "W999999", "w1000000", "cats"])], "_stop int, text string")
    kept = ["cat", None, "", "w1000000", "cats"]
    small = spark.createDataFrame([("the",), (None,), ("été",), ("",), ("W17",), ("w999999",)], "word string")
    large = small.union(spark.range(1_000_000).select(F.concat(F.lit("w"), F.col("id").cast("string"))))
    for stoplist, most in ((small, 1 << 20), (small, 0), (large, 1 << 20)):
        found = tables.without_stopwords(tokens, stoplist, broadcast_bytes=most)
        assert found.columns == tokens.columns and [r.text for r in found.orderBy("_stop").collect()] == kept
    assert tables.without_stopwords(tokens, small.limit(0)).count() == 10
    assert tables.without_stopwords(tokens, small.where("word is null")).count() == 10


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(tables, "FILTER_BITS", 64)
    words = spark.range(3000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    found = tables.without_stopwords(words, words.where("length(text) < 5"), broadcast_bytes=0)
    assert found.count() == 2000 and found.where("length(text) < 5").count() == 0


@pytest.mark.parametrize(("low", "high"), [(1, 1), (1, 3), (2, 4), (3, 3), (5, 7)])
def test_grams_as_rows(spark, low, high):
    """The rows are the items of the array in the same order."""
    texts = [[], ["a"], *[[f"w{i}" for i in range(n)] for n in (2, 3, 4, 5, 6, 9)], ["x", "x", None, "x"]]
    df = spark.createDataFrame(list(enumerate(texts)), "_size int, t array<string>")
    rows = tables.explode_ngrams(df, F.col("t"), low, high, ["_size"])
    whole = df.select("_size", F.posexplode(ngrams.ngrams_range("t", low, high)).alias("pos", "gram"))
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, whole.withColumn("pos", F.col("pos").cast("long")).collect()))
    with pytest.raises(ValueError, match="grams"):
        tables.explode_ngrams(df, F.col("t"), 0, 2, ["_size"])


def test_grams_of_a_million_words(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: (i % 1000).cast("string")).alias("t"))
    found = tables.explode_ngrams(df, F.col("t"), 2, 3, []).agg(F.count("*").alias("n"), F.max("pos").alias("last"), F.count_distinct(F.array_join("gram", " ")).alias("d")).first()
    assert tuple(found) == (1_999_997, 1_999_996, 2000)


def test_text_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "docs")
    docs(spark).write.parquet(path)
    plan = tables.explode_tokens(spark.read.parquet(path).where("doc_id = 1"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,1)]" in plan
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_csv(spark, tmp_path):
    source, target = tmp_path / "in.csv", str(tmp_path / "out")
    source.write_text('name,note\nComte,"a ""b"", c"\nKnight,"two\nlines"\n', encoding="utf-8")
    names.encode_csv(spark, str(source), target)
    with open(glob.glob(f"{target}/part-*")[0], encoding="utf-8", newline="") as f:
        rows = list(csv.reader(f, escapechar=None))
    assert rows[0] == ["name", "note", "phonogram"] and [r[2] for r in rows[1:]] == ["knt", "nt"]
    again = names.read_csv(spark, target).collect()
    assert [r.note for r in again] == ['a "b", c', "two\nlines"]


def test_names(spark):
    assert [tuple(r) for r in names.encode_names(spark, ["Dupont", "O"]).collect()] == [("Dupont", "dp"), ("O", "o")]


def test_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(1, "a b a", "2024-01-01 00:01:00"), (2, "b!", "2024-01-01 00:12:00")]
    spark.createDataFrame(rows, "doc_id long, text string, t string").withColumn("t", F.to_timestamp("t")).write.parquet(path)
    stream = spark.readStream.schema("doc_id long, text string, t timestamp").parquet(path)
    query = tokens.token_stream(stream).writeStream.format("memory").queryName("toks").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("toks").count() == 5
    counted = tokens.windowed_counts(stream, "t")
    query = counted.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r.text, r.n) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1), ("!", 1)}
