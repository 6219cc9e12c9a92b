"""Byte-level BPE by the ranks of a public vocabulary: a perfect hash, and merging on a heap.

A text is split by a pattern, and each piece is encoded alone. A minimal perfect hash holds the
whole vocabulary; a piece in it is one token. Any other piece is merged: its bytes form a linked
list, a heap gives the adjacent pair of least rank, leftmost first, and the pair becomes one.
The hash is built once, on the driver, and broadcast: it is as large as the vocabulary.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType


class PerfectHash:
    """Keys 0..n-1 by a hash without free places: hash and displace.

    Keys are dealt to buckets; from the largest on, each bucket gets the first seed that sends
    its keys to places that are free. Look-ups compare the key that is there.
    """

    def __init__(self, keys: list[bytes], load: float = 3.0):
        self.n = n = len(keys)
        self.m = max(1, int(n / load))
        buckets: list[list[int]] = [[] for _ in range(self.m)]
        hashes = [xxhash.xxh3_128_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets[(h >> 32 & 0xFFFFFFFF) % self.m].append(i)
        self.seeds = np.zeros(self.m, dtype=np.int64)
        self.slots = np.full(n, -1, dtype=np.int64)
        free = iter(())
        for b in sorted(range(self.m), key=lambda b: -len(buckets[b])):
            some = buckets[b]
            if len(some) > 1:
                seed = 1
                while True:
                    at = [self._place(hashes[i], seed) for i in some]
                    if len(set(at)) == len(at) and all(self.slots[a] < 0 for a in at):
                        break
                    seed += 1
                self.seeds[b] = seed
                self.slots[at] = some
            elif some:  # single keys take what is left, by its number
                a = next(free, None)
                if a is None:
                    free = iter(np.flatnonzero(self.slots < 0).tolist())
                    a = next(free)
                self.seeds[b] = -a - 1
                self.slots[a] = some[0]
        self.seeds, self.slots = self.seeds.tolist(), self.slots.tolist()
        self.keys = keys

    def _place(self, h: int, seed: int) -> int:
        x = (h + seed * 0x9E3779B1 & 0xFFFFFFFF) * (h >> 96 | 1)
        return ((x ^ x >> 29) & 0xFFFFFFFF) * self.n >> 32

    def get(self, key: bytes) -> int:
        """The number of a key, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_128_intdigest(key)
        seed = self.seeds[(h >> 32 & 0xFFFFFFFF) % self.m]
        i = self.slots[-seed - 1 if seed < 0 else self._place(h, seed)]
        return i if i >= 0 and self.keys[i] == key else -1


class Vocabulary:
    """Ranks from the lines of a rank file, which are its tokens in base64 and their ids."""

    def __init__(self, lines: bytes):
        rows = [line.split() for line in lines.splitlines() if line.strip()]
        self.ids = [int(b) for _, b in rows]
        self.hash = PerfectHash([base64.b64decode(a) for a, _ in rows])
        self.ready()

    def ready(self) -> None:
        self.of_id = dict(zip(self.ids, self.hash.keys, strict=True))
        self.parts = dict(zip(self.hash.keys, self.ids, strict=True))

    def __getstate__(self) -> tuple:
        return self.ids, self.hash

    def __setstate__(self, state: tuple) -> None:
        self.ids, self.hash = state
        self.ready()

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.hash.get(piece)
        return [self.ids[whole]] if whole >= 0 else self._merge(piece)

    def _merge(self, piece: bytes) -> list[int]:
        n, rank = len(piece), self.parts.get
        bits = n.bit_length()
        low, both = (1 << bits) - 1, 2 * bits  # in the heap: rank, start and end of a pair
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [r << both | i << bits | i + 2 for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i, stop = x >> bits & low, x & low
            j = after[i]
            if j < 0 or j >= n or end[j] != stop:
                continue  # one of the two has been merged meanwhile
            k = after[j]
            end[i], after[i], after[j] = stop, k, -1
            if k < n:
                before[k] = i
                if (r := rank(piece[i : end[k]])) is not None:
                    heappush(heap, r << both | i << bits | end[k])
            k = before[i]
            if k >= 0 and (r := rank(piece[k:stop])) is not None:
                heappush(heap, r << both | k << bits | stop)
        out, i = [], 0
        while i < n:
            out.append(self.parts[piece[i : end[i]]])
            i = after[i]
        return out


@lru_cache(1)
def vocabulary(lines: bytes) -> Vocabulary:
    return Vocabulary(lines)


class _Packed(dict):
    """The ids of a piece as little-endian numbers: the last ``most`` pieces or up to twice as many."""

    most = 400_000

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        x = self.old.get(piece)
        if x is None:
            ids = self.vocabulary.encode(piece.encode())
            x = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 256:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = x
        return x


def encode(documents: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Add ``out_col``, the ids of a text as little-endian unsigned 32-bit numbers.

    ``ranks`` is the content of a rank file. A null text is empty. All columns are kept; one that
    is named as the new one is replaced.
    """

    shared = _shared(documents, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, split = _Packed(shared.value), regex.compile(pattern).findall
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string())
            found = [b"".join(map(packed.__getitem__, split(t))) if t else b"" for t in _each(column)]
            yield _with(batch, out_col, pa.array(found, pa.binary()))

    return documents.mapInArrow(run, _schema(documents, out_col))


def decode(documents: DataFrame, ranks: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``, the bytes that the ids of ``encode`` stand for."""

    shared = _shared(documents, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = shared.value.of_id.__getitem__
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            found = [b"".join(map(part, np.frombuffer(x or b"", "<u4").tolist())) for x in _each(column)]
            yield _with(batch, out_col, pa.array(found, pa.binary()))

    return documents.mapInArrow(run, _schema(documents, out_col))


def _shared(df: DataFrame, ranks: bytes) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast(vocabulary(ranks))


def _each(column: pa.Array) -> Iterator:
    for i in range(0, len(column), 64):
        yield from column.slice(i, 64).to_pylist()


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    kept = [i for i, f in enumerate(batch.schema.names) if f != name]
    return pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], column], [*[batch.schema.names[i] for i in kept], name])


def _schema(df: DataFrame, name: str) -> StructType:
    return StructType([*[f for f in df.schema if f.name != name], StructField(name, BinaryType())])


def encoded_digests(documents: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, number of ids, digests of the ids and of the bytes decoded from them.

    A null text is empty and has no ids. Every row counts, also rows that repeat or have no id; an
    empty table gives no rows, and other columns are ignored.
    """
    there = encode(documents.select(id_col, text_col), ranks, pattern, text_col).select(id_col, "ids")
    return decode(there, ranks).select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
