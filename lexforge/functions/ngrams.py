"""N-grams of arrays: every window of n items; a shorter sequence is one gram by itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions.normalize import ColumnOrName, bind, column


def checked_sizes(low: int, high: int) -> None:
    if low < 1 or high < low:
        raise ValueError(f"n-grams of {low} to {high} items")


def ngrams(col: ColumnOrName, n: int) -> Column:
    """All windows of ``n`` items in order; an empty array has none."""
    checked_sizes(n, n)

    def windows(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1)))
        return F.when(F.size(t) > 0, F.transform(starts, lambda i: F.slice(t, i, n))).otherwise(F.filter(F.array(t), lambda x: F.lit(False)))

    return bind(column(col), windows)


def ngrams_range(col: ColumnOrName, low: int, high: int) -> Column:
    """All windows of ``low`` to ``high`` items.

    First come those inside the first ``high`` items, by size and then by place; then, for each
    further item, those that end with it, by size.
    """
    checked_sizes(low, high)

    def windows(t: Column) -> Column:
        head = F.least(F.lit(high), F.size(t))
        sizes = F.sequence(F.lit(low), F.greatest(head, F.lit(low)))
        first = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), head - n + 1), lambda i: F.slice(t, i, n))))
        ends = F.sequence(head + 1, F.greatest(F.size(t), head + 1))
        later = F.flatten(F.transform(ends, lambda j: F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.slice(t, j - n + 1, n))))
        none = F.filter(F.array(t), lambda x: F.lit(False))
        return F.when(F.size(t) == 0, none).when(F.size(t) < low, F.array(t)).when(F.size(t) <= high, first).otherwise(F.concat(first, later))

    return bind(column(col), windows)


def ngrams_len(tokens: ColumnOrName, n: int) -> Column:
    """An estimate of the number of n-grams: 0 where there is one token less than n."""
    count = column(tokens)
    if n < 1:
        return F.lit(0)
    return F.when(count <= 0, 0).when(count < n - 1, 1).otherwise(count - (n - 1))


def ngrams_range_len(tokens: ColumnOrName, low: int, high: int) -> Column:
    """An estimate of the number of grams of all sizes from ``low`` to ``high``."""
    count = column(tokens)
    if low < 1:
        return F.lit(0)
    total = sum((ngrams_len(count, n) for n in range(low, high + 1)), start=F.lit(0))
    return F.when(count <= 0, 0).when(count < low, 1).otherwise(total)
