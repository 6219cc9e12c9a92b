"""Quality rules for documents and for the hosts they come from, in SQL expressions only.

A document fails a rule by itself. Per host and rule, failures are counted and the rate is shrunk
by a beta prior, which is fitted to all hosts by moments, so a host of few documents is judged
like the others. A host whose shrunk rate is at least the limit fails, and so do its documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm._shared import durable

#: Shrunk rates of failure at which a host fails: by rule.
HOST_LIMITS = {"base": 0.5, "symbols": 0.5, "lines": 0.5}
#: Documents' prior weight where all hosts are alike or there is only one.
LARGEST_PRIOR = 1000.0


def with_measures(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of whole texts; null: none."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    solid = F.translate(text, " \t\n\x0b\f\r", "")
    step = documents.withColumn("_text", text)
    step = step.withColumns(
        {
            "_words": F.expr(r"filter(split(_text, '[ \\t-\\r]+'), w -> w <> '')"),
            "_lines": F.expr(r"filter(split(_text, '\n'), l -> translate(l, ' \t\u000b\u000c\r', '') <> '')"),
            "word_chars": F.length(solid).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate(F.col("_text"), "#*$%&|<>", ""))).cast("long"),
        }
    )
    step = step.withColumns({"n_words": F.size("_words").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    step = step.drop("_lines", "_text")
    hashed = F.expr("if(n_words < 3, array(), transform(sequence(0, n_words - 3), i -> xxhash64(_words[int(i)], _words[int(i) + 1], _words[int(i) + 2])))").cast("array<long>")
    step = step.withColumn("_windows", hashed).drop("_words")
    step = step.withColumn("_repeats", F.size("_windows") > F.size(F.array_distinct("_windows")))
    # windows in order; those equal to a neighbour repeat, and each covers three words that the next may share
    ordered = F.expr("if(_repeats, sort_array(transform(_windows, (h, i) -> struct(h as h, i as i))), array())")
    step = step.withColumn("_ordered", ordered).drop("_windows", "_repeats")
    found = F.expr("sort_array(transform(filter(_ordered, (x, i) -> x.h = get(_ordered, i - 1).h or x.h = get(_ordered, i + 1).h), x -> x.i))")
    step = step.withColumn("_places", found).drop("_ordered")
    covered = F.expr("aggregate(_places, struct(0L as n, -3 as last), (s, p) -> struct(s.n + least(3, p - s.last) as n, p as last), s -> s.n)")
    return step.withColumn("n_repeat_words", covered).drop("_places")


def rules() -> dict[str, Column]:
    """Whether one document fails a rule, by its measures."""
    return {
        "base": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "lines": 20 * F.col("n_dup_lines") > F.col("n_words"),
    }


def host_rates(failures: DataFrame, host_col: str, rules: list[str]) -> DataFrame:
    """(host, rate of each rule): (failures + a) / (documents + a + b), a and b by moments over hosts.

    With m the mean of the hosts' rates and v their variance, a + b = m (1 - m) / v - 1, at least 0
    and at most LARGEST_PRIOR.
    """
    hosts = failures.groupBy(host_col).agg(F.count("*").alias("_docs"), *[F.sum(F.col(r).cast("long")).alias(r) for r in rules])
    raw = [F.col(r) / F.col("_docs") for r in rules]
    moments = hosts.agg(*[x for r, p in zip(rules, raw, strict=True) for x in (F.avg(p).alias(f"{r}_m"), F.var_pop(p).alias(f"{r}_v"))]).first()

    def rate(r: str) -> Column:
        m, v = moments[f"{r}_m"] or 0.0, moments[f"{r}_v"] or 0.0
        weight = max(0.0, min(LARGEST_PRIOR, m * (1 - m) / v - 1)) if v > 0 else LARGEST_PRIOR
        return ((F.col(r) + m * weight) / (F.col("_docs") + weight)).alias(r)

    return hosts.select(host_col, *[rate(r) for r in rules])


def judge(documents: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", limits: dict[str, float] | None = None) -> DataFrame:
    """Per document: id, the measures, ``base_failed`` and ``kept``.

    Documents without a host are one host of their own. Rows may repeat; each counts. Other columns
    are ignored. An empty table has no verdicts.
    """
    limits = limits or HOST_LIMITS
    own = rules()
    names = [r for r in own if r in limits]
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))
    measured = with_measures(documents.select(F.col(id_col).alias("_id"), host.alias("_host"), F.col(text_col).alias("_body")), "_body").drop("_body")
    measured = durable(measured.select("_id", "_host", *measures, *[F.coalesce(own[r], F.lit(False)).alias(f"_{r}") for r in own]))
    rates = host_rates(measured.select("_host", *[F.col(f"_{r}").alias(r) for r in names]), "_host", names)
    bad = reduce(lambda a, b: a | b, [F.col(r) >= limits[r] for r in names])
    verdicts = rates.select("_host", bad.alias("_bad"))
    return measured.join(verdicts, "_host", "left").select(
        F.col("_id").alias(id_col), *measures, F.col("_base").alias("base_failed"), (~F.col("_base") & ~F.coalesce("_bad", F.lit(False))).alias("kept")
    )
