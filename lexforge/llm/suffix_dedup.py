"""Removal of passages that repeat anywhere in the corpus, by suffix arrays.

A passage is a string of ``length`` bytes. Where it starts, one of its ``KMER``-byte substrings
has the smallest hash, and equal passages agree on it. Runs of consecutive passages that share
that substring form a segment, so each passage of a text lies in one segment and equal passages
lie in segments of the same hash. That decides what has to be compared and sends it to one shard:

1. A scan cuts every text into segments and returns a short row for each: hash, digest, place.
   Hashes that occur once go. Where all segments of a hash have one digest they are copies, and
   all of their passages repeat.
2. The bytes of one segment of each other digest are gathered into shards by hash. A shard builds
   its suffix array by Larsson-Sadakane refinement, which doubles the sorted depth and goes on only
   with groups not yet told apart, and common prefixes by Kasai's rule, that the next place's
   prefix is at most one shorter: only places whose preceding bytes differ are compared.
3. The segments of a hash that has more than a shard holds are cut into segments again, by the
   smallest hash under another function, up to ``LEVELS`` times. What one hash still has too much of
   fills several shards, which are merged in pairs: passages of the one are found in the suffix array
   of the other by binary search.
4. Repeated runs go back by digest to all places with it, and then to the documents.

Texts are shuffled once by id; groups of copies are counted before the shuffle, and the places of a
hash that very many share are dealt over tasks by salts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm._shared import durable
from lexforge.llm.words import mixed, powers, texts

KMER = 48
PIECE = 1 << 19
SHARD_BYTES = 2_000_000
LEVELS = 4
#: A hash with more segments than both this and its share is dealt over several tasks; at most so many are, and come to the driver.
HOT_ROWS = 20_000
HOT_HASHES = 1000
_PLACE = (1 << 24) - 1


def repeated_spans(documents: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, runs): lists of runs [from, to) of bytes to remove, for each document that has any.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. A null
    text is empty. Every row is a document of its own, also one that repeats an id, with its text
    or another one, or that has none. ``id`` is the id, or 0 without one, and ``key`` what
    ``row_key`` gives: rows of one id and one text have the same runs.
    """
    docs = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), row_key(id_col, text_col).alias("key"), F.col(id_col).isNull().alias("none"), F.col(text_col).cast("string").alias("text"))
    ends = F.expr(f"transform(runs, (x, i) -> start + x + if(i % 2 = 1, {length - 1}, 0))")
    return _repeats(docs, length).select("id", "key", ends.alias("runs")).groupBy("id", "key").agg(F.collect_set("runs").alias("runs"))


def _salts(hot: DataFrame) -> Column:
    """Over how many tasks the rows of each ``mh`` are dealt: a power of two for those in ``hot``, whose rows are few and come to the driver."""
    sizes: dict[int, list[int]] = {}
    for r in hot.collect():
        sizes.setdefault(1 << (r["salts"] - 1).bit_length(), []).append(r["mh"])
    salts = F.lit(1).cast("long")
    for size, hashes in sizes.items():
        salts = F.when(F.col("mh").isin(hashes), F.lit(size).cast("long")).otherwise(salts)
    return salts


def row_key(id_col: str, text_col: str) -> Column:
    """A hash that tells the texts of an id apart, and rows without an id from others."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(text_col).cast("string"))


def _repeats(docs: DataFrame, length: int, level: int = 0) -> DataFrame:
    """(id, key, start, runs): ranges of passages, counted from a place, that also start anywhere else."""
    rows = docs.where(F.octet_length("text") >= length).mapInArrow(_segments(length, level), "mh long, dg long, id long, key long, start long, n int")
    common = durable(rows.groupBy("mh").agg(F.count("*").alias("c"), F.min("dg").alias("x"), F.max("dg").alias("y")).where("c > 1"))
    total = common.agg(F.sum("c")).first()[0] or 0
    least = max(HOT_ROWS, total // HOT_HASHES)  # so fewer than HOT_HASHES have more
    salts = _salts(common.where(F.col("c") > least).select("mh", F.ceil(F.col("c") / least).cast("long").alias("salts")))
    dealt = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("id", "key", "start"), salts))
    copied = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    held = durable(dealt(rows).join(copied(common.select("mh", (F.col("x") == F.col("y")).alias("same"))), ["mh", "salt"]))
    kinds = held.groupBy("mh", "dg", "same").agg(F.count("*").alias("c"), F.min(F.struct("id", "key", "start", "n")).alias("at"))
    kinds = durable(kinds.select("mh", "dg", "same", "c", "at.id", "at.key", "at.start", "at.n"))
    known = kinds.where("c > 1").select("mh", "dg", F.expr("array(0, n)").alias("runs"))
    found = _compare(docs, kinds.where("not same"), length, level)
    fresh = found.join(kinds.where("c = 1").select("mh", "dg"), ["mh", "dg"], "left_semi")
    return held.join(copied(known.union(fresh)), ["mh", "dg", "salt"]).select("id", "key", "start", "runs")


def remove_repeats(documents: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every document: its id, ``kept``, the bytes left of it, and ``spans``, what was removed, as maximal runs.

    Other columns are ignored; an empty table gives no rows.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("own"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    docs = docs.join(repeated_spans(documents, length, id_col, text_col), ["id", "key"], "left").select("own", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for text, runs in zip(texts(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
                merged = _merged(runs or [])
                at, parts = 0, []
                for x, y in merged:
                    parts.append((text or b"")[at:x])
                    at = y
                kept.append(b"".join([*parts, (text or b"")[at:]]))
                removed.append([{"from": x, "to": y} for x, y in merged])
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(kept, pa.binary()), pa.array(removed, kind)], [id_col, "kept", "spans"])

    return docs.mapInArrow(cut, f"`{id_col}` long, kept binary, spans array<struct<from: long, to: long>>")


def _merged(lists: list[list[int]]) -> list[tuple[int, int]]:
    pairs = sorted((x, y) for runs in lists for x, y in zip(runs[::2], runs[1::2], strict=True))
    out: list[tuple[int, int]] = []
    for x, y in pairs:
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


@lru_cache(1)
def _bytes() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64))


def _anchors(data: np.ndarray, length: int, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each place where a string of ``length`` bytes starts, what its anchor has (equal at two
    places only if the anchor is the same one), and the hash of the substring at each place. Levels
    have hash functions of their own."""
    up, down = powers(PIECE + 4096)
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_bytes()[data] * up[:n], out=total[1:])
    m = n - KMER + 1
    full = mixed((total[KMER:] - total[:m]) * down[:m])
    for _ in range(level):
        full = mixed(full + np.uint64(1))
    low = (full & ~np.uint64(_PLACE)) | np.arange(m, dtype=np.uint64)
    width, have = length - KMER + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    return low, full


def _segments(length: int, level: int):
    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int, int, int, int]]]]:
        """Bytes, and in them for each text or part of one: id, key, offset in the text, first and last byte."""
        got, held, at = [], [], 0
        for doc, key, text in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), texts(batch.column("text")), strict=True):
            for x in range(0, max(1, len(text) - length + 1), PIECE - length + 1):
                part = text[x : x + PIECE]
                if at and at + len(part) > PIECE:
                    yield b"".join(got), held
                    got, held, at = [], [], 0
                got.append(part)
                held.append((doc, key, x, at, at + len(part)))
                at += len(part)
        if at:
            yield b"".join(got), held

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, held in pieces(batch):
                low, full = _anchors(np.frombuffer(raw, np.uint8), length, level)
                first = np.array([h[3] for h in held])
                stop = np.array([h[4] for h in held])
                new = np.ones(len(low), dtype=bool)
                new[1:] = low[1:] != low[:-1]
                new[first[first < len(low)]] = True
                over = stop - length + 1  # no passage of this text starts here or later
                dead = np.zeros(len(low) + 1, dtype=np.int64)
                np.add.at(dead, np.minimum(over, len(low)), 1)
                np.add.at(dead, np.minimum(stop, len(low)), -1)
                dead = np.cumsum(dead)[:-1] > 0
                new[over[over < len(low)]] = True
                at = np.flatnonzero(new)
                end = np.append(at[1:], len(low))
                live = ~dead[at]
                at, end = at[live], end[live]
                owner = np.searchsorted(first, at, side="right") - 1
                ids, keys = (np.array([h[k] for h in held], dtype=np.int64) for k in (0, 1))
                shift = np.array([h[2] - h[3] for h in held])
                view = memoryview(raw)
                dg = np.array([xxhash.xxh3_64_intdigest(view[x : y + length - 1]) for x, y in zip(at.tolist(), end.tolist(), strict=True)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full[(low[at] & np.uint64(_PLACE)).astype(np.int64)].view(np.int64)), pa.array(dg.view(np.int64)), pa.array(ids[owner]), pa.array(keys[owner]), pa.array(at + shift[owner]), pa.array((end - at).astype(np.int32))],
                    ["mh", "dg", "id", "key", "start", "n"],
                )

    return scan


def _compare(docs: DataFrame, kinds: DataFrame, length: int, level: int) -> DataFrame:
    """(mh, dg, runs): ranges of passages in a segment that also start in another segment."""
    size = F.col("n") + length - 1
    loads = kinds.groupBy("mh").agg(F.sum(size).alias("bytes"))
    total = loads.agg(F.sum(F.when(F.col("bytes") <= SHARD_BYTES, F.col("bytes")))).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_BYTES))
    large = loads.where(F.col("bytes") > SHARD_BYTES).select("mh", F.ceil(F.col("bytes") / SHARD_BYTES).alias("cuts"))
    placed = kinds.join(large, "mh", "left").select(
        "id",
        "key",
        F.struct(
            F.when(F.col("cuts").isNull(), F.pmod("mh", F.lit(shards))).otherwise(F.col("mh")).alias("shard"),
            F.when(F.col("cuts").isNull(), F.lit(-1)).otherwise(F.pmod("dg", "cuts")).cast("int").alias("cut"),
            "mh",
            "dg",
            "start",
            "n",
        ).alias("at"),
    )
    wanted = placed.groupBy("id", "key").agg(F.collect_list("at").alias("at"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, at in zip(texts(batch.column("text")), batch.column("at").to_pylist(), strict=True):
                rows += [(p["shard"], p["cut"], p["mh"], p["dg"], text[p["start"] : p["start"] + p["n"] + length - 1]) for p in at]
                if len(rows) > 20_000:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)

    names, kinds_of = ["shard", "cut", "mh", "dg", "bytes"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds_of)], names)

    # of rows without an id that have the same text, one is read
    each = docs.where("not none").union(docs.where("none and text is not null").dropDuplicates(["id", "key"]))
    parts = each.join(wanted, ["id", "key"]).select("text", "at").mapInArrow(fetch, "shard long, cut int, mh long, dg long, bytes binary")
    schema = "mh long, dg long, runs array<int>"

    def alone(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["mh", "dg"])
        return _told(frame, SuffixArray(frame["bytes"].tolist()).repeated(length), length)

    if not large.take(1):
        return durable(parts.groupBy("shard").applyInPandas(alone, schema))
    parts = durable(parts)
    gathered = lambda hits: durable(hits.groupBy("mh", "dg").agg(F.flatten(F.collect_list("runs")).alias("runs")))
    if level < LEVELS:
        inside = parts.where("cut < 0").groupBy("shard").applyInPandas(alone, schema)
        # these numbers hold only once they are written
        again = durable(parts.where("cut >= 0").dropDuplicates(["mh", "dg"]).select(F.monotonically_increasing_id().alias("id"), F.lit(0).cast("long").alias("key"), F.lit(False).alias("none"), F.col("bytes").alias("text"), "mh", "dg"))
        finer = _repeats(again.drop("mh", "dg"), length, level + 1)
        shifted = F.expr("transform(runs, x -> cast(start + x as int))").alias("runs")
        return gathered(inside.union(finer.drop("key").join(again.drop("key", "none", "text"), "id").select("mh", "dg", shifted)))
    inside = parts.groupBy("shard", "cut").applyInPandas(alone, schema)
    side = lambda x: parts.where("cut >= 0").groupBy("shard", "cut").agg(F.collect_set(F.struct("mh", "dg", "bytes")).alias(x))
    pairs = side("a").withColumnRenamed("cut", "i").join(side("b").withColumnRenamed("cut", "j"), "shard").where("i <> j").select("a", "b")

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b in zip(frame["a"], frame["b"], strict=True):
                mine = pd.DataFrame([tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in a], columns=["mh", "dg", "bytes"])
                yield _told(mine, SuffixArray([bytes(r["bytes"]) for r in b]).holds(mine["bytes"].tolist(), length), length)

    return gathered(inside.union(pairs.mapInPandas(merge, schema)))


def _told(frame: pd.DataFrame, hit: list[np.ndarray], length: int) -> pd.DataFrame:
    rows = []
    for mh, dg, mask in zip(frame["mh"], frame["dg"], hit, strict=True):
        if mask.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
            rows.append((mh, dg, edge.tolist()))
    return pd.DataFrame(rows, columns=["mh", "dg", "runs"])


class SuffixArray:
    """The suffixes of some strings in order; each string ends in a mark of its own."""

    def __init__(self, strings: list[bytes]):
        # a mark is a number in bytes that UTF-8 never has, so nothing in a text equals any part of it
        marked = [s + b"\xff" + bytes(0xF5 + int(c) for c in f"{i:07d}") for i, s in enumerate(strings)]
        self.sizes = [len(s) for s in strings]
        self.starts = np.cumsum([0, *map(len, marked)])[:-1]
        self.n = sum(map(len, marked))
        self.text = np.frombuffer(b"".join(marked) + bytes(512), np.uint8)
        self.words = np.ndarray((len(self.text) - 7,), ">u8", self.text.data, 0, (1,)).astype(np.uint64)
        self.order = self._sorted()

    def _sorted(self) -> np.ndarray:
        n, depth = self.n, 8
        order = np.argsort(self.words[:n]).astype(np.int32)
        new = np.ones(n, dtype=bool)
        new[1:] = self.words[order[1:]] != self.words[order[:-1]]
        rank = np.zeros(n + 512, dtype=np.int32)
        group = np.flatnonzero(new)
        rank[order] = np.repeat(group, np.diff(np.append(group, n))).astype(np.int32) + 1
        left = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in the order that are not settled
        while len(left) and depth < n:
            at = order[left]
            key = (rank[at].astype(np.int64) << 32) | rank[np.minimum(at + depth, n)]
            by = np.argsort(key)
            at, key = at[by], key[by]
            order[left] = at
            new = np.ones(len(left), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            group = np.flatnonzero(new)
            rank[at] = np.repeat(left[group], np.diff(np.append(group, len(left)))).astype(np.int32) + 1
            left = left[~(new & np.append(new[1:], True))]
            depth *= 2
        return order

    def prefixes(self) -> np.ndarray:
        """For each place, the bytes it shares with the suffix before it in the order."""
        n = self.n
        before = np.full(n, -1, dtype=np.int64)
        before[self.order[1:]] = self.order[:-1]
        place = np.arange(n)
        fresh = np.ones(n, dtype=bool)  # Kasai: else it is one less than at the place before
        both = (place > 0) & (before > 0)
        fresh[both] = self.text[place[both] - 1] != self.text[before[both] - 1]
        p = place[fresh]
        q = before[p]
        size = np.zeros(len(p), dtype=np.int64)
        live = np.flatnonzero(q >= 0)
        while len(live):
            x, y = p[live] + size[live], q[live] + size[live]
            inside = np.maximum(x, y) < n
            differ = self.words[np.minimum(x, n)] ^ self.words[np.minimum(y, n)]
            same = inside & (differ == 0)
            part = live[inside & ~same]
            d = differ[inside & ~same]
            for k in range(1, 8):
                size[part] += d < np.uint64(1 << (64 - 8 * k))
            size[live[same]] += 8
            live = live[same]
        total = np.zeros(n, dtype=np.int64)
        total[p] = size + p
        last = np.maximum.accumulate(np.where(fresh, place, 0))
        return np.maximum(total[last] - place, 0)

    def repeated(self, length: int) -> list[np.ndarray]:
        """For each string, which of its substrings of ``length`` bytes start anywhere else."""
        shared = self.prefixes() >= length
        hit = shared.copy()
        after = self.order[:-1][shared[self.order[1:]]]
        hit[after] = True
        return [hit[s : s + size - length + 1] for s, size in zip(self.starts.tolist(), self.sizes, strict=True)]

    def holds(self, strings: list[bytes], length: int) -> list[np.ndarray]:
        """For each string, which of its substrings of ``length`` bytes start in these, by binary search."""
        out = []
        for s in strings:
            data = np.frombuffer(s + bytes(8), np.uint8)
            words = np.ndarray((len(data) - 7,), ">u8", data.data, 0, (1,)).astype(np.uint64)
            count = len(s) - length + 1
            low, high = np.zeros(count, dtype=np.int64), np.full(count, self.n, dtype=np.int64)
            while (open_ := low < high).any():
                mid = (low + high) // 2
                less = self._less(np.where(open_, self.order[np.minimum(mid, self.n - 1)], 0), words, length)[0]
                low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
            inside = low < self.n
            out.append(inside & self._less(self.order[np.minimum(low, self.n - 1)], words, length)[1])
        return out

    def _less(self, at: np.ndarray, words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether the suffixes are less than, and whether they start with, the query at 0, 1, 2..."""
        less, same = np.zeros(len(at), dtype=bool), np.ones(len(at), dtype=bool)
        mine = np.arange(len(at))
        for k in [*range(0, length - 7, 8), length - 8]:
            live = np.flatnonzero(same)
            if not len(live):
                break
            x = self.words[np.minimum(at[live].astype(np.int64) + k, len(self.words) - 1)]
            y = words[mine[live] + k]
            less[live] = x < y
            same[live] = x == y
        return less & ~same, same
