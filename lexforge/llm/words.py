"""Words of many texts as 64-bit numbers, by whole arrays of bytes.

A word is a run of bytes other than the space and U+0009 to U+000D; A-Z count as a-z. Its number
is a polynomial of its bytes modulo 2**64 with random coefficients, mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15


def texts(column: pa.Array) -> list[bytes | None]:
    """The texts of a column as UTF-8."""
    return column.cast(pa.binary()).to_pylist()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses."""
    up, down = np.ones(n, dtype=np.uint64), np.ones(n, dtype=np.uint64)
    up[1:] = np.multiply.accumulate(np.full(n - 1, _BASE, dtype=np.uint64))
    down[1:] = np.multiply.accumulate(np.full(n - 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64))
    return up, down


@lru_cache(1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte, and which bytes are white space."""
    numbers = mixed(np.arange(1, 257, dtype=np.uint64))
    numbers[65:91] = numbers[97:123]
    white = np.zeros(256, dtype=bool)
    white[[32, *range(9, 14)]] = True
    return numbers, white


def pieces(column: Sequence[bytes | None]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Runs of texts: the first one's index, their bytes joined by a space, and where each begins."""
    first, got, size = 0, [], 0
    for i, text in enumerate(column):
        if got and size + len(text or b"") > PIECE:
            yield first, b" ".join(got), np.cumsum([0, *(len(t) + 1 for t in got[:-1])])
            first, got, size = i, [], 0
        got.append(text or b"")
        size += len(got[-1]) + 1
    if got:
        yield first, b" ".join(got), np.cumsum([0, *(len(t) + 1 for t in got[:-1])])


def word_numbers(column: Sequence[bytes | None], head: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first one's index, the words of each, and all words' numbers in order.

    With ``head``, each word is followed by the number of its first ``head`` characters, or of itself.
    """
    numbers, white = _bytes()
    for first, raw, begins in pieces(column):
        data = np.frombuffer(raw, np.uint8)
        solid = np.zeros(len(data) + 2, dtype=np.int8)
        solid[1:-1] = ~white[data]
        edge = np.flatnonzero(np.diff(solid))
        start, end = edge[::2], edge[1::2]
        up, down = powers(max(PIECE + 2, 1 << len(data).bit_length()))
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(numbers[data] * up[: len(data)], out=total[1:])
        found = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        counts = np.diff(np.searchsorted(start, np.append(begins, len(data) + 1)))
        if head:
            first_bytes = np.append(np.flatnonzero((data & 0xC0) != 0x80), np.full(head, len(data)))  # of characters
            stop = np.minimum(end, first_bytes[np.searchsorted(first_bytes, start) + head])
            heads = mixed((total[stop] - total[start]) * down[start] + np.uint64(1 << 20))
            found, counts = np.column_stack([found, heads]).ravel(), 2 * counts
        yield first, counts, found


def shingle_sets(column: Sequence[bytes | None], k: int, weight: np.ndarray | None = None) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray] | None, np.ndarray]]:
    """For runs of texts: the first one's index, each one's distinct ``k``-word shingles, ascending,
    what ``weight`` gives for them, and the numbers of all words.

    A text of fewer words is one shingle; one without words has none. ``weight`` has a number for
    the first 16 bits of a word's number; then the third item has the sum of its words' for each shingle.
    """
    steps = [np.uint64(pow(_BASE, 2 * i + 3, 1 << 64)) for i in range(k)]
    for first, counts, found in word_numbers(column):
        m = max(0, len(found) - k + 1)
        whole = np.full(m, k, dtype=np.uint64)
        load = np.zeros(m)
        each = None if weight is None else weight[(found >> np.uint64(48)).astype(np.int64)]
        for i in range(k if m else 0):
            x = found[i : m + i]
            whole += x * steps[i] ^ x >> np.uint64(31)
            if each is not None:
                load += each[i : m + i]
        whole = mixed(whole)
        sets, loads, at = [], [], 0
        for n in counts.tolist():
            if n >= k:
                x = whole[at : at + n - k + 1]
                if each is None:
                    x = np.sort(x)
                else:
                    by = np.argsort(x)
                    x = x[by]
                keep = np.empty(len(x), dtype=bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                sets.append(x[keep])
                if each is not None:
                    loads.append(load[at : at + n - k + 1][by[keep]])
            elif n:
                total = np.full(1, n, dtype=np.uint64)
                for i in range(n):
                    total = mixed(total * steps[i] + found[at + i])
                sets.append(total)
                loads.append(np.zeros(1))
            else:
                sets.append(found[:0])
                loads.append(np.zeros(0))
            at += n
        yield first, sets, loads if each is not None else None, found
