"""Personal data: base patterns, and contextual extraction bootstrapped from what they find.

The base finds are seed instances. The words beside an instance are lexical patterns of its kind.
Strings that only resemble an identifier (a phone number without a country code, a card number
that fails its check digit, an address without a domain's dot, a dotted number out of range) are
instances not yet believed. Spark scores the graph of patterns and instances in rounds: a pattern
by the mean score of its instances, shrunk towards 0, an instance by the noisy-or of its patterns.
Scores only rise, so they have a limit, and rounds go on until all are near it. Strings at or above
the acceptance score are spans too.

One scan yields a short row per document; only those rows are joined and grouped. Each base search
is linear in the length of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm._shared import durable, unused

KINDS = ("email", "ip", "card", "phone")
#: Scoring ends when no score rises by so much.
STILL = 1e-3
#: A pattern of n instances whose scores sum to s has confidence s / (n + PRIOR).
PRIOR = 1.0
ACCEPT = 0.5

_DIGIT = re.compile("[0-9]")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a failed search from the head of a run of digits fails from inside it too, hence the look-behind
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE = (
    ("email", re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]++(?:[.-][0-9]++){3}(?![0-9])")),
    ("card", re.compile(r"[0-9](?:[ -]?[0-9]){11,}")),
    ("phone", re.compile(r"\(?[0-9][ ().0-9-]+[0-9]")),
)
_BLANK = " \t\n\x0b\f\r"
_RIGHT = re.compile(r"[^\x20\x09-\x0D]*+[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)")
_EDGE = ".,;:!?\"'()[]{}<>"

Span = tuple[str, int, int]


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    low = 0
    for m in _HOST.finditer(text):
        at = m.start()
        while at > low and text[at - 1] in _LOCAL:
            at -= 1
        if at < m.start():
            yield "email", at, m.end()
            low = m.end()


def base_spans(text: str | None) -> list[Span]:
    """Base finds as (kind, from, to) in code points, by start and then by kind as listed."""
    out: list[Span] = []
    if not text:
        return out
    if "@" in text:
        out += _emails(text)
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _loose_spans(text: str, base: list[Span]) -> list[Span]:
    """Strings that resemble an identifier and overlap no base find."""
    taken = sorted((x, y) for _, x, y in base)
    out = []
    for kind, pattern in _LOOSE:
        if kind == "email" and "@" not in text or kind != "email" and not _DIGIT.search(text):
            continue
        i = 0
        for m in pattern.finditer(text):
            x, y = m.span()
            while i < len(taken) and taken[i][1] <= x:
                i += 1
            n = len(_digits(m[0]))
            if any(p < y and x < q for p, q in taken[i : i + 4]) or kind == "card" and n > 19 or kind == "phone" and not 7 <= n <= 15 or kind == "ip" and n > 12:
                continue
            out.append((kind, x, y))
    return out


def _word_before(text: str, at: int) -> tuple[int, str]:
    """Where the word before a blank begins, and the word; "" if there is none."""
    stop = at
    while stop and text[stop - 1] in _BLANK:
        stop -= 1
    start = stop
    while stop < at and start and text[start - 1] not in _BLANK:
        start -= 1
    return start, text[start:stop]


def _contexts(text: str, kind: str, x: int, y: int) -> list[int]:
    """Lexical patterns around a string, as numbers: two words before it, and a word on each side.

    The second needs one word before, so a string near a text's start has it too. A string that
    follows no blank has none, so each word of a text is read a few times at most.
    """
    at, near = _word_before(text, x)
    if not near:
        return []
    far = _word_before(text, at)[1]
    a, b = (w.strip(_EDGE).lower() for w in (far, near))
    right = _RIGHT.match(text, y)
    c = right[1].strip(_EDGE).lower() if right else ""
    found = [f"{kind}|{a} {b} _"] if a and b and not _DIGIT.search(a + b) else []
    found += [f"{kind}|{b} _ {c}"] if b and c and not _DIGIT.search(b + c) else []
    return [xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) - (1 << 63) for p in found]


def _digest(text: str) -> Column:
    """What tells the texts of rows apart that repeat an id or have none; a null text is empty."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def find_private(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """One row per document: id, ``base`` and ``extra``, arrays of (kind, from, to) in code points.

    A null text is empty. Rows that repeat an id are judged each by its own text, also those
    without an id. Other columns are ignored. ``extra`` holds what the contexts add, in order.
    """
    return _found(documents, id_col, text_col, accept).select(F.col("id").alias(id_col), "base", "extra")


def _found(documents: DataFrame, id_col: str, text_col: str, accept: float) -> DataFrame:
    """One row per document: ``id``, ``i`` and ``none`` (the id, or 0 and true), ``key`` (the text's digest), ``base``, ``extra``."""
    span = pa.struct([("kind", pa.string()), ("from", pa.int64()), ("to", pa.int64())])
    loose = pa.struct([("kind", pa.string()), ("from", pa.int64()), ("to", pa.int64()), ("seed", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, looses = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                some = [(s, True) for s in base] + [(s, False) for s in (_loose_spans(text, base) if base or "@" in text or _DIGIT.search(text) else [])]
                bases.append([dict(zip(("kind", "from", "to"), s, strict=True)) for s in base])
                looses.append(
                    [
                        {"kind": k, "from": x, "to": y, "seed": seed, "instance": xxhash.xxh3_64_intdigest(f"{k}|{_digits(text[x:y]) if k != 'email' else text[x:y].lower()}".encode()) - (1 << 63), "patterns": _contexts(text, k, x, y)}
                        for (k, x, y), seed in some
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(bases, pa.list_(span)), pa.array(looses, pa.list_(loose))], ["id", "key", "base", "loose"]
            )

    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), _digest(text_col).alias("key"))
    kept = "id long, key long, base array<struct<kind: string, from: long, to: long>>"
    found = durable(docs.mapInArrow(scan, f"{kept}, loose array<struct<kind: string, from: long, to: long, seed: boolean, instance: long, patterns: array<long>>>"))
    mentions = found.select("id", "key", F.explode("loose").alias("m")).select("id", "key", "m.*")
    believed = _believed(mentions, accept)
    extra = (
        mentions.where("not seed")
        .join(believed, "instance")
        .groupBy(F.coalesce("id", F.lit(0)).alias("i"), F.col("id").isNull().alias("none"), "key")
        .agg(F.array_sort(F.collect_set(F.struct("from", "kind", "to"))).alias("extra"))
    )
    rows = found.select("id", "key", "base", F.coalesce("id", F.lit(0)).alias("i"), F.col("id").isNull().alias("none"))
    return rows.join(extra, ["i", "none", "key"], "left").select(
        "id",
        "i",
        "none",
        "key",
        "base",
        F.coalesce(F.expr("transform(extra, x -> struct(x.kind as kind, x.from as from, x.to as to))"), F.array().cast("array<struct<kind: string, from: long, to: long>>")).alias("extra"),
    )


def _believed(mentions: DataFrame, accept: float) -> DataFrame:
    """The instances that the graph of patterns and instances gives the acceptance score at least.

    Scores start at 1 for seeds and 0 for others and can only rise, towards the least fixed point;
    rounds go on until no score rises by ``STILL`` or more.
    """
    edges = durable(mentions.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    scores = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score"), F.lit(1.0).alias("rise"))
    while True:
        patterns = edges.join(scores, "instance").groupBy("pattern").agg((F.sum("score") / (F.count("*") + PRIOR)).alias("confidence"))
        told = edges.join(patterns, "pattern").groupBy("instance").agg(F.greatest(F.max("seed").cast("double"), 1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        scores = durable(told.join(scores.select("instance", F.col("score").alias("before")), "instance").select("instance", "score", (F.col("score") - F.col("before")).alias("rise")))
        if scores.where(F.col("rise") >= STILL).isEmpty():
            return scores.where(F.col("score") >= accept).select("instance")


def spans_text(spans: Column) -> Column:
    """kind:from:to of spans by start, then by kind as listed, joined by commas."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(spans, lambda s: F.struct(s["from"].alias("from"), F.array_position(order, s["kind"]).alias("rank"), s["to"].alias("to"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.sort_array(keyed), lambda s: F.concat_ws(":", s["kind"], s["from"], s["to"])), ",")


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with each personal span replaced by its kind in brackets; columns stay.

    Of spans that overlap, the whole stretch is replaced by the first one's kind. Every row is
    redacted by its own text, also rows that repeat an id and those without one. A null text stays.
    """
    spans = _found(documents, id_col, text_col, ACCEPT).where(F.size("base") + F.size("extra") > 0)
    names = documents.columns
    *keys, listed_in = unused(names, "_id", "_none", "_digest", "_spans")
    # rows of one id and one text have the same spans
    listed = spans.groupBy(*[F.col(c).alias(k) for c, k in zip(("i", "none", "key"), keys, strict=True)]).agg(F.first(F.concat("base", "extra")).alias(listed_in))
    number = F.col(id_col).cast("long")
    docs = documents.withColumns(dict(zip(keys, (F.coalesce(number, F.lit(0)), number.isNull(), _digest(text_col)), strict=True)))

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            at = batch.schema.get_field_index(text_col)
            for text, some in zip(batch.column(at).to_pylist(), batch.column(listed_in).to_pylist(), strict=True):
                parts, last = [], 0
                for s in sorted(some or [], key=lambda s: (s["from"], -s["to"])):
                    if s["from"] >= last:
                        parts += [text[last : s["from"]], f"[{s['kind'].upper()}]"]
                    last = max(last, s["to"])
                out.append("".join([*parts, text[last:]]) if parts else text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text_col else batch.column(n) for n in names], names)

    return docs.join(listed, keys, "left").select(*names, listed_in).mapInArrow(replace, documents.schema)
