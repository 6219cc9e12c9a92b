"""Language identification by interpolated Kneser-Ney models of characters.

A text is its runs of letters in lower case. Each is a word between two boundary signs, and each
language has a model of a word's characters and its end, given up to ``ORDER`` - 1 signs before.
The language of lowest cross-entropy in bits a character over all words of a text is its language.

Fitting is SQL over a bounded sample of rows: words are counted once for each language, and their
substrings give the grams. The longest grams, and those that begin a word, count as they occur;
others count the signs that occur before them. With a discount for each language and order, a gram
has a discounted share of its context, and a context has the weight that it leaves to the shorter
one. Both are arrays by ascending hash, a column for each language, which a task searches.

A text's words repeat, so a task scores each distinct word of a batch once, and keeps the scores of
words that it has met. A logistic curve over how far the best language is ahead, fitted on sampled
rows that no gram was counted in, calibrates the score: the chance that the answer is right.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm._shared import durable
from lexforge.llm.toxicity import held_out
from lexforge.llm.words import mixed, powers

#: Longest gram in characters.
ORDER = 4
#: Bound, about, of the sample by a hash of the id: rows with each language. One in four only calibrates.
LABELLED = 2000
#: Bound of the model that the driver builds and every task gets: grams and contexts, times languages. Beyond it rare grams of three signs and more go.
CELLS = 1 << 22
#: Texts whose score is below this are rejected.
REJECT = 0.5
UNKNOWN = "und"

#: Boundary signs: control characters, which are no letters.
_BEGIN, _END = "\x02", "\x03"
#: Characters of a text that are read at once; a longer run of letters counts as several words.
PIECE = 1 << 20
#: Words whose scores a task keeps.
KEPT = 1 << 18


@dataclass
class LanguageModel:
    """``keys[k]`` are the hashes of all grams of k + 1 signs, ``shares[k]`` their discounted shares by
    language (0 if unseen); ``contexts[k]`` the hashes of all contexts of k signs, ``left[k]`` the
    weights that they leave (1 if unseen). Each array has one more row, for what is in none."""

    languages: list[str]
    keys: list[np.ndarray]
    shares: list[np.ndarray]
    contexts: list[np.ndarray]
    left: list[np.ndarray]
    uniform: float
    curve: np.ndarray


def _hashed(col: list[str]) -> np.ndarray:
    """Hashes of short strings, as ``_rolled`` gives them."""
    if not col:
        return np.zeros(0, dtype=np.uint64)
    codes = np.frombuffer("".join(col).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(x) for x in col])
    start = np.cumsum(size) - size
    total, down = _totals(codes)
    return _rolled(total, down, start, size)


@lru_cache(1)
def _signs() -> np.ndarray:
    """A number for each code point."""
    return mixed(np.arange(1, 0x110001, dtype=np.uint64))


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
    found = np.zeros(0x110000, dtype=bool)
    for run in regex.finditer(r"\p{L}+", every):
        found[run.start() : run.end()] = True
    return found


def _totals(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(max(PIECE * 2, 1 << len(codes).bit_length()))
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_signs()[codes] * up[: len(codes)], out=total[1:])
    return total, down


def _rolled(total: np.ndarray, down: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    return mixed((total[start + size] - total[start]) * down[start] + np.asarray(size).astype(np.uint64))


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted hash, or that after the last one."""
    at = np.searchsorted(keys, wanted)
    at[at < len(keys)] = np.where(keys[at[at < len(keys)]] == wanted[at < len(keys)], at[at < len(keys)], len(keys))
    return at


def word_bits(model: LanguageModel, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bits of each word with its end in each language; words are ``codes[start:end]``, of one letter at least."""
    size = end - start
    n = len(size)
    first = np.cumsum(size + 2) - (size + 2)
    signs = np.empty(int((size + 2).sum()), dtype=np.uint32)
    inner = np.ones(len(signs), dtype=bool)
    inner[first] = inner[first + size + 1] = False
    signs[first], signs[first + size + 1] = ord(_BEGIN), ord(_END)
    steps = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    signs[inner] = codes[np.repeat(start, size) + steps]
    total, down = _totals(signs)
    told = np.ones(len(signs), dtype=bool)
    told[first] = False
    place = np.flatnonzero(told)  # what is predicted: all signs but the first one of each word
    depth = place - np.repeat(first, size + 1)  # signs before it
    p = np.full((len(place), len(model.languages)), model.uniform)
    for k in range(ORDER):
        has = np.flatnonzero(depth >= k)
        at = place[has]
        gram = _found(model.keys[k], _rolled(total, down, at - k, k + 1))
        context = _found(model.contexts[k], _rolled(total, down, at - k, k))
        p[has] = model.shares[k][gram] + model.left[k][context] * p[has]
    return -np.add.reduceat(np.log2(p), np.cumsum(size + 1) - (size + 1), axis=0) if n else np.zeros((0, p.shape[1]))


class Scorer:
    """Scores texts by a model and keeps the scores of words that it has met."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.known = np.zeros(0, dtype=np.uint64)
        self.bits = np.zeros((0, len(model.languages)), dtype=np.float32)

    def texts(self, column: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the bits of its words in each language, and the signs that they predict (0: no letter)."""
        bits, signs = np.zeros((len(column), len(self.model.languages))), np.zeros(len(column), dtype=np.int64)
        rows: list[int] = []
        parts: list[str] = []
        size = 0
        for i, text in enumerate(column):
            for at in range(0, len(text or ""), PIECE):
                part = text[at : at + PIECE].lower()
                rows.append(i)
                parts.append(part)
                size += len(part) + 1
                if size >= PIECE:
                    self._add(rows, parts, bits, signs)
                    rows, parts, size = [], [], 0
        if parts:
            self._add(rows, parts, bits, signs)
        return bits, signs

    def _add(self, rows: list[int], parts: list[str], bits: np.ndarray, signs: np.ndarray) -> None:
        codes = np.frombuffer(" ".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        solid = np.zeros(len(codes) + 2, dtype=np.int8)
        solid[1:-1] = _letters()[codes]
        edge = np.flatnonzero(np.diff(solid))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return
        sizes = np.array([len(p) + 1 for p in parts])
        row = np.array(rows)[np.searchsorted(np.cumsum(sizes), start, side="right")]
        total, down = _totals(codes)
        words, one, which = np.unique(_rolled(total, down, start, end - start), return_index=True, return_inverse=True)
        each = self._words(words, codes, start[one], end[one])[which]
        for k in range(bits.shape[1]):
            bits[:, k] += np.bincount(row, each[:, k], len(bits))
        signs += np.bincount(row, end - start + 1, len(signs)).astype(np.int64)

    def _words(self, words: np.ndarray, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        at = _found(self.known, words)
        new = np.flatnonzero(at == len(self.known))
        out = np.empty((len(words), self.bits.shape[1]), dtype=np.float32)
        old = np.flatnonzero(at < len(self.known))
        out[old] = self.bits[at[old]]
        step = 1 << 15
        for x in range(0, len(new), step):
            some = new[x : x + step]
            out[some] = word_bits(self.model, codes, start[some], end[some])
        if len(self.known) + len(new) > KEPT:
            self.known, self.bits = words, out
        elif len(new):
            self.known = np.concatenate([self.known, words[new]])
            order = np.argsort(self.known)
            self.known, self.bits = self.known[order], np.concatenate([self.bits, out[new]])[order]
        return out


def _facts(bits: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the best language, and what its chance is told by: its lead in bits a sign and over the text, its bits, the text's size."""
    rate = bits / np.maximum(signs, 1)[:, None]
    best = rate.argmin(1)
    low = rate[np.arange(len(rate)), best]
    if rate.shape[1] > 1:
        lead = np.partition(rate, 1, axis=1)[:, 1] - low
    else:
        lead = np.full(len(rate), 1.0)
    return best, np.column_stack([np.ones(len(rate)), np.minimum(lead, 4), np.log1p(lead * signs), np.minimum(low, 32) / 8, np.log1p(signs) / 8])


def _chance(curve: np.ndarray, facts: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(facts @ curve, -30, 30)))


def _sample(documents: DataFrame) -> DataFrame:
    """lang, text, apart: about LABELLED rows of each language, those ``apart`` only for the curve."""
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    share = known.groupBy("lang").agg((F.lit(float(LABELLED)) / F.count("*")).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return known.withColumn("draw", draw).join(F.broadcast(share), "lang").where("draw < share").select("lang", "text", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0).alias("apart"))


def _grams(rows: DataFrame, least: int) -> DataFrame:
    """lang, gram, n, order: how often each gram counts, of those of three signs and more that occur ``least`` times."""
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    signs = F.concat(F.lit(_BEGIN), "w", F.lit(_END))
    cut = lambda s: F.flatten(
        F.transform(F.sequence(F.lit(1), F.lit(ORDER)), lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.length(s)), lambda i: i + k - 1 <= F.length(s)), lambda i: F.substring(s, i, k)))
    )
    raw = words.withColumn("s", signs).select("lang", "n", F.explode(cut(F.col("s"))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n")).where((F.length("gram") < 3) | (F.col("n") >= least))
    raw = durable(raw.where(F.col("gram") != _BEGIN))
    before = raw.where(F.length("gram") > 1).groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("before"))
    counted = raw.join(before, ["lang", "gram"], "left")
    whole = (F.length("gram") == ORDER) | F.col("gram").startswith(_BEGIN)
    n = F.when(whole, F.col("n")).otherwise(F.coalesce("before", F.lit(1)))
    return durable(counted.select("lang", "gram", n.alias("n"), F.length("gram").alias("order")))


def train(documents: DataFrame) -> LanguageModel | None:
    """A model of every language that has sampled rows; None if there is none.

    Rows that are held out, and rows without id, text or language, teach nothing; rows that repeat
    count as often. Tables of at most ``CELLS`` numbers come to the driver.
    """
    sample = durable(_sample(documents.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))))
    fitted = sample.where("not apart")
    if fitted.isEmpty():
        fitted = sample
    least = 1
    while True:
        grams = _grams(fitted, least)
        size = grams.agg(F.count_distinct("gram"), F.count_distinct("lang")).first()
        if not size[0]:
            return None
        if 2 * size[0] * size[1] <= CELLS:
            break
        least *= 2
    by = grams.groupBy("lang", "order").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
    discount = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    sized = grams.join(F.broadcast(by.select("lang", "order", F.least(discount, F.lit(0.95)).alias("d"))), ["lang", "order"])
    context = F.expr("substring(gram, 1, order - 1)")
    contexts = durable(sized.groupBy("lang", "order", context.alias("context")).agg(F.sum("n").alias("total"), (F.first("d") * F.count("*") / F.sum("n")).alias("left")))
    shares = sized.withColumn("context", context).join(contexts, ["lang", "order", "context"]).select("lang", "order", "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("share"))
    model = _arrays(shares.toPandas(), contexts.select("lang", "order", "context", "left").toPandas())
    model.curve = _calibrated(sample.where("apart"), model)
    return model


def _arrays(shares, contexts) -> LanguageModel:
    languages = sorted(shares["lang"].unique())
    column = {x: i for i, x in enumerate(languages)}

    def table(frame, name: str, value: str, rest: float) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(_hashed(frame[name].tolist()), return_inverse=True)
        values = np.full((len(keys) + 1, len(languages)), rest, dtype=np.float32)
        values[at, frame["lang"].map(column).to_numpy(int)] = frame[value]
        return keys, values

    keys, parts = zip(*[table(shares[shares["order"] == k + 1], "gram", "share", 0.0) for k in range(ORDER)], strict=True)
    hashes, left = zip(*[table(contexts[contexts["order"] == k + 1], "context", "left", 1.0) for k in range(ORDER)], strict=True)
    return LanguageModel(languages, list(keys), list(parts), list(hashes), list(left), 1 / (len(keys[0]) + 1), np.array([0.0, 4, 1, -1, 1]))


def _calibrated(rows: DataFrame, model: LanguageModel) -> np.ndarray:
    """A logistic curve over ``_facts``; the driver gets a few numbers for each row of the sample."""
    known = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(known.value)
        for batch in batches:
            bits, signs = scorer.texts(batch.column("text").to_pylist())
            best, facts = _facts(bits, signs)
            right = [known.value.languages[b] == x for b, x in zip(best, batch.column("lang").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(right), *[pa.array(f) for f in facts.T]], ["right", *(f"f{i}" for i in range(facts.shape[1]))]).filter(pa.array(signs > 0))

    start = model.curve
    found = rows.mapInArrow(run, "right boolean, " + ", ".join(f"f{i} double" for i in range(len(start)))).toPandas()
    x, y = found.iloc[:, 1:].to_numpy(float), found["right"].to_numpy(float)
    curve = start.copy()
    for _ in range(100):
        p = _chance(curve, x)
        slope = x.T @ (p - y) + 0.1 * (curve - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(curve)), slope)
        curve = curve - step
        if np.abs(step).max() < 1e-9:
            break
    return curve


def identify(documents: DataFrame, model: LanguageModel | None, reject: float = REJECT) -> DataFrame:
    """The documents' ids with lang_pred, score, bits (a sign, in that language) and rejected.

    ``lang_pred`` is a language of the model; of languages that tie, the first by name. It is
    ``und`` with score 0 for texts that are null or have no letter, and for all without a model.
    ``rejected`` says that the score is below ``reject``, or that there is no language. Every row is
    judged by its own text; rows may repeat, ids may be null, and other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, lang_pred string, score double, bits double, rejected boolean"
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"), F.lit(True).alias("rejected"))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(known.value)
        for whole in batches:
            for x in range(0, len(whole), 512):
                batch = whole.slice(x, 512)
                bits, signs = scorer.texts(batch.column("text").to_pylist())
                best, facts = _facts(bits, signs)
                some = signs > 0
                score = np.where(some, _chance(known.value.curve, facts), 0.0)
                names = [known.value.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                rate = pa.array(bits[np.arange(len(bits)), best] / np.maximum(signs, 1), mask=~some)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), rate, pa.array(score < reject)], ["doc_id", "lang_pred", "score", "bits", "rejected"])

    return docs.mapInArrow(run, schema)


def predict_language(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits and rejected of every document, by a model of those that are not held out."""
    found = identify(documents, train(documents))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits", "rejected")
