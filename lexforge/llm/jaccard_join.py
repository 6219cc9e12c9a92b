"""Jaccard similarity join of whole texts by a token-group matrix.

1. Documents with equal shingle sets are one class, which its smallest id stands for.
2. A first scan counts words and shingles in fixed numbers of buckets. The counts only order
   shingles, rare ones first and among them those of rare words; by that order a prefix of each set
   is taken, so long that linked sets share not one shingle of their prefixes but a number that
   grows with their sizes.
3. Classes are partitioned into groups of similar ones by a few min-hashes of their whole sets. Of
   the classes that agree under one, the leader is that whose min-hashes most classes share, so the
   middle of a cloud of near copies leads it; a class joins the leader that it agrees with most.
4. A group is cut where it would be large; each part is compared in itself and with the first part,
   where the leader is. What that connects is one group from now on, however large: links inside it
   are of no more interest.
5. The matrix has a row (shingle, group) for each shingle in the union of the group's prefixes, so
   a group of thousands of near copies counts once for each shingle. A row also bounds the sizes of
   sets that may link through it: a shingle far back in a prefix serves only for smaller partners.
   Groups that share enough such rows, and whose bins (counts of shingles by hash, which bound any
   overlap) allow a link, are a candidate pair, and are compared part by part.
6. A task gets two packed parts, bounds the overlap of each query with the union of the other
   part's sets and opens the part if the bound allows a link. Exact set sizes decide.
7. The links' spanning forests go through distributed connected components.

Whole sets are made again only for groups of several classes and those in candidate pairs. No group
is dropped or capped: a large group is cut into parts, and all parts are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm._shared import components, durable
from lexforge.llm.words import mixed, shingle_sets, texts

#: Buckets of words and of shingles in which the first scan counts.
WORD_BUCKETS = 1 << 16
BUCKETS = 1 << 18
_CHUNK = 1 << 14
KEYS = 8
#: Classes that agree with a leader under so many of these share its group.
AGREE = 3
#: A power of two.
BINS = 64
#: A prefix is longer than it must be by one shingle for so many of the set.
SHARE = 100
PART_DOCS = 256
PART_TOKENS = 400_000


def jaccard_components(
    documents: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest id reachable by links).

    Two documents link when ``100 * intersection >= percent * union`` of their sets of distinct
    ``k``-word shingles. A null or blank text has an empty set and links with nothing. Each row gets
    the component of its own text, so rows that repeat an id with other texts may differ; a
    component's id is the smallest id of its rows that have one, and null where none has. An empty
    table gives no rows, and other columns are ignored.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = durable(_prefixes(docs, k, percent, _counts(docs, k)))
    some = sets.where("id is not null and n > 0")
    reps = durable(some.groupBy("s1", "s2").agg(F.min("id").alias("id"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("prefix", "keys", "bins")]))
    held = durable(_shared_tokens(reps, percent))
    near = durable(_groups(reps))
    cuts, parts = _cut(near)
    first = durable(_settle(_within(durable(_pack(docs, parts, k)), cuts), percent))
    merged = components(first).withColumnRenamed("node", "id")
    groups = durable(reps.select("id", "n", "bins").join(merged, "id", "left").select("id", "n", "bins", F.coalesce("root", "id").alias("lead")))
    second = durable(_settle(_across(docs, held, groups, k, percent), percent))
    roots = components(first.union(second))
    classes = reps.select("s1", "s2", F.col("id").alias("node")).join(roots, "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("component"))
    return sets.join(classes, ["s1", "s2"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"),
    )


def _counts(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of word counts by bucket, and how far shingle counts exceed what chance gives.

    Each task sends its counts as a few packed rows, and so many come to the driver, however many
    documents there are.
    """
    chunks = (WORD_BUCKETS + BUCKETS) // _CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WORD_BUCKETS + BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, sets, _, found in shingle_sets(texts(batch.column(0)), k):
                total[:WORD_BUCKETS] += np.bincount((found >> np.uint64(48)).astype(np.int64), minlength=WORD_BUCKETS)
                np.add.at(total, WORD_BUCKETS + (np.concatenate(sets) >> np.uint64(46)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(chunks)), pa.array([x.tobytes() for x in np.split(total, chunks)], pa.binary())], ["chunk", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for chunk, n in zip(batch.column("chunk").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if chunk != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.tobytes()], pa.binary())], ["chunk", "n"])
                    now, total = chunk, np.zeros(_CHUNK, dtype=np.int64)
                total = total + np.frombuffer(n, np.int64)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total.tobytes()], pa.binary())], ["chunk", "n"])

    schema = "chunk long, n binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, schema).collect()
    out = np.zeros((chunks, _CHUNK), dtype=np.int64)
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["n"], np.int64)
    words, shingles = out.ravel()[:WORD_BUCKETS], out.ravel()[WORD_BUCKETS:]
    usual = np.median(shingles)
    more = np.maximum(0.0, (shingles - usual) / (np.sqrt(usual) + 1))
    return np.log(np.maximum(words, 1)), np.where(more > 3, np.ceil(np.log2(more + 1)), 0.0)


def _shared(n):
    """How many shingles of its prefix a set of n has in common with that of any linked set, at least
    (of two linked sets, the smaller such number)."""
    return 1 + n // SHARE


def _row(tokens: np.ndarray, load: np.ndarray, more: np.ndarray, percent: int) -> tuple:
    """Size, 128 bits that stand for the set, its prefix, min-hashes and shingles in each bin."""
    size = len(tokens)
    long = xxhash.xxh3_128_intdigest(tokens.tobytes())
    reach = size - (percent * size + 99) // 100
    rare = tokens[np.lexsort((load, more[(tokens >> np.uint64(46)).astype(np.int64)]))[: reach + _shared(size)]]
    keys = [mixed(tokens ^ np.uint64(i + 1)).min().view(np.int64) if size else 0 for i in range(KEYS)]
    bins = np.bincount((tokens & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS).astype(np.int32)
    return size, (long >> 64) - (1 << 63), (long & ((1 << 64) - 1)) - (1 << 63), rare.view(np.int64), keys, bins


def _prefixes(docs: DataFrame, k: int, percent: int, counts: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(x, load, counts[1], percent) for _, sets, loads, _ in shingle_sets(texts(batch.column("text")), k, counts[0]) for x, load in zip(sets, loads, strict=True)]
            n, s1, s2, prefixes, keys, hist = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [], [], [])
            ends = np.cumsum([0, *map(len, prefixes)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)])))
            bins = pa.ListArray.from_arrays(pa.array(np.arange(0, BINS * len(n) + 1, BINS), pa.int32()), pa.array(np.concatenate([*hist, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists, pa.array(keys, pa.list_(pa.int64())), bins],
                ["id", "n", "s1", "s2", "prefix", "keys", "bins"],
            )

    return docs.mapInArrow(make, "id long, n long, s1 long, s2 long, prefix array<long>, keys array<long>, bins array<int>")


def _shared_tokens(reps: DataFrame, percent: int) -> DataFrame:
    """(id, token, n, reach): prefix shingles that more than one class has in its prefix.

    Of sets of n and m shingles that link, at least t = percent (n + m) / (100 + percent) are common,
    so the first ones of these are at places up to n - t + shared - 1 of the one: a shingle at some
    place serves for partners of up to ``reach`` shingles. A class needs enough such shingles.
    """
    rows = reps.select("id", "n", F.posexplode("prefix").alias("p", "token"))
    reach = F.floor((F.col("n") + F.floor(F.col("n") / SHARE) - F.col("p")) * (100 + percent) / percent) - F.col("n")
    rows = rows.select("id", "token", F.col("n").cast("int"), F.least(reach, F.lit((1 << 31) - 1)).cast("int").alias("reach"))
    common = rows.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    return rows.join(common, "token").select("id", "token", "n", "reach")


def _side_bins(groups: DataFrame, x: str) -> DataFrame:
    return groups.select(F.col("lead").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("low", "high", "bins")])


def _allowed(percent: int):
    """Whether sizes and bins of two groups, a and b, leave room for a link."""
    bound = F.expr("aggregate(zip_with(a_bins, b_bins, (x, y) -> least(x, y)), 0, (s, x) -> s + x)")
    return _sizes(percent) & ((100 + percent) * bound >= percent * (F.col("a_low") + F.col("b_low")))


def _sizes(percent: int):
    return (100 * F.col("a_high") >= percent * F.col("b_low")) & (100 * F.col("b_high") >= percent * F.col("a_low"))


def _groups(reps: DataFrame) -> DataFrame:
    """(id, n, lead): classes that agree with a leader under enough min-hashes, and the leader itself.

    Which classes share a group decides where links are looked for first, not which are found.
    """
    keyed = reps.select("id", "n", F.posexplode("keys").alias("k", "key"))
    common = keyed.groupBy("k", "key").agg(F.count("*").alias("c")).where("c > 1")
    alike = durable(keyed.join(common, ["k", "key"]))
    middle = alike.groupBy("id").agg(F.sum("c").alias("c"))
    best = alike.join(middle.withColumnRenamed("c", "all"), "id").groupBy("k", "key").agg(F.max(F.struct("all", (-F.col("id")).alias("id"), "n")).alias("x"))
    agreed = alike.select("id", "n", "k", "key").join(best, ["k", "key"]).groupBy("id", "n", "x").agg(F.count("*").alias("agree")).where(F.col("agree") >= AGREE)
    led = agreed.groupBy("id", "n").agg(F.max(F.struct("agree", "x")).alias("x")).select("id", "n", (-F.col("x.x.id")).alias("lead"), F.col("x.x.n").alias("lead_n"))
    led = durable(led.where("id <> lead"))
    return led.select("id", "n", "lead").union(led.select("lead", "lead_n", "lead").distinct())


def _candidates(held: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: groups that share enough rows of the matrix and whose sizes and bins allow a link."""
    most = durable(groups.groupBy("lead").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.array(*[F.max(F.col("bins")[i]) for i in range(BINS)]).alias("bins")))
    known = groups.select("id", "lead")
    matrix = held.join(known, "id").groupBy("token", "lead").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("reach").alias("reach"))
    matrix = durable(matrix)
    common = matrix.groupBy("token").agg(F.min("lead").alias("x"), F.max("lead").alias("y")).where("x <> y").select("token")
    rows = durable(matrix.join(common, "token"))
    side = lambda x: rows.select("token", F.col("lead").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("low", "high", "reach")])
    fits = (F.col("a_low") <= F.col("b_reach")) & (F.col("b_low") <= F.col("a_reach")) & _sizes(percent)
    shared = side("a").join(side("b"), "token").where((F.col("a") < F.col("b")) & fits)
    pairs = shared.groupBy("a", "b").agg(F.count("*").alias("both"), F.min(F.least("a_low", "b_low")).alias("low"))
    pairs = pairs.where(F.col("both") >= 1 + F.floor(F.col("low") / SHARE)).select("a", "b")
    return durable(pairs.join(_side_bins(most, "a"), "a").join(_side_bins(most, "b"), "b").where(_allowed(percent)).select("a", "b"))


def _cut(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lead, cuts, docs) of each group, and (id, part, split): each group in as many parts."""
    sizes = groups.groupBy("lead").agg(F.ceil(F.greatest(F.count("*") / PART_DOCS, F.sum("n") / PART_TOKENS)).alias("cuts"), F.count("*").alias("docs"))
    cut = F.when(F.col("id") == F.col("lead"), 0).otherwise(F.pmod(F.xxhash64("id"), "cuts"))
    return sizes, groups.select("id", "lead").join(sizes, "lead").select("id", F.concat_ws(".", "lead", cut).alias("part"), (F.col("cuts") > 1).alias("split"))


def _pack(docs: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """(part, split, ids, ends, tokens): the whole sets of a part's classes one after another.

    Texts are compressed for the shuffle that brings them to their parts.
    """

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([press(t or b"") for t in texts(batch.column("text"))], pa.binary())], ["id", "small"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            column = [whole(t) for t in batch.column("small").to_pylist()]
            sets = [x.tobytes() for _, some, _, _ in shingle_sets(column, k) for x in some]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), batch.column("split"), pa.array(sets, pa.binary())], ["id", "part", "split", "tokens"])

    found = docs.where("id is not null").mapInArrow(small, "id long, small binary").join(parts, "id").select("id", "part", "split", "small")
    return _packed(found.mapInArrow(make, "id long, part string, split boolean, tokens binary"))


def _packed(sets: DataFrame) -> DataFrame:
    """Rows of a part come one after another after a sort; a row goes out where the next part begins."""

    def row(part: str, split: bool, ids: list[int], tokens: list[bytes]) -> pa.RecordBatch:
        ends = np.cumsum([len(x) // 8 for x in tokens], dtype=np.int64)
        packs = (np.array(ids, np.int64).tobytes(), ends.tobytes(), b"".join(tokens))
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([split]), *[pa.array([x], pa.binary()) for x in packs]], ["part", "split", *_FIELDS])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, tokens = None, [], []
        for batch in batches:
            for part, split, i, x in zip(*(batch.column(c).to_pylist() for c in ("part", "split", "id", "tokens")), strict=True):
                if now and part != now[0]:
                    yield row(*now, ids, tokens)
                    ids, tokens = [], []
                if not ids or ids[-1] != i:
                    ids.append(i)
                    tokens.append(x)
                now = part, split
        if ids:
            yield row(*now, ids, tokens)

    return sets.repartition("part").sortWithinPartitions("part", "id").mapInArrow(pack, "part string, split boolean, ids binary, ends binary, tokens binary")


_FIELDS = ("ids", "ends", "tokens")


def _side(packed: DataFrame, x: str) -> DataFrame:
    return packed.select(F.col("part").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in _FIELDS])


def _within(packed: DataFrame, cuts: DataFrame) -> list[DataFrame]:
    """Parts to compare: each with itself, and with the first of its group."""
    own = packed.where("length(ids) > 8").select(*[F.col(c).alias(f"a_{c}") for c in _FIELDS], *[F.lit(None).cast("binary").alias(f"b_{c}") for c in _FIELDS])
    more = cuts.where("cuts > 1").select("lead", F.explode(F.sequence(F.lit(1).cast("long"), F.col("cuts") - 1)).alias("c"))
    pairs = more.select(F.concat_ws(".", "lead", F.lit(0)).alias("a"), F.concat_ws(".", "lead", "c").alias("b"))
    split = packed.where("split")
    return [own, pairs.join(_side(split, "a"), "a").join(_side(split, "b"), "b").select(*own.columns)]


def _across(docs: DataFrame, held: DataFrame, groups: DataFrame, k: int, percent: int) -> list[DataFrame]:
    """Parts of groups that share rows of the matrix and whose bins allow a link."""
    pairs = _candidates(held, groups, percent)
    used = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "lead")
    sizes, parts = _cut(groups.join(used, "lead", "left_semi"))
    packed = durable(_pack(docs, parts, k))
    each = lambda x: sizes.select(F.col("lead").alias(x), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias(f"{x}_cut"))
    named = lambda x: F.concat_ws(".", x, f"{x}_cut").alias(x)
    pairs = pairs.join(each("a"), "a").join(each("b"), "b").select(named("a"), named("b"))
    both = pairs.join(_side(packed, "a"), "a").join(_side(packed, "b"), "b")
    return [both.select(*[f"{x}_{c}" for x in "ab" for c in _FIELDS])]


class _Part:
    """A packed part of a group in a task: its classes' sets one after another, and their union."""

    def __init__(self, ids: bytes, ends: bytes, tokens: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.ends = np.frombuffer(ends, np.int64)
        self.tokens = np.frombuffer(tokens, np.uint64)
        self.sizes = np.diff(self.ends, prepend=0)

    def united(self) -> _Part:
        self.union, self.place = np.unique(self.tokens, return_inverse=True)
        self.owner = np.repeat(np.arange(len(self.ids)), self.sizes)
        return self

    def each(self) -> Iterator[tuple[int, np.ndarray]]:
        start = 0
        for i, end in enumerate(self.ends):
            yield i, self.tokens[start:end]
            start = end

    def overlaps(self, query: np.ndarray, least: int) -> np.ndarray | None:
        """Overlap of each class with the query, or None if the union rules out ``least``."""
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        at = at[self.union[at] == query]
        if len(at) < least:
            return None
        mark = np.zeros(len(self.union), dtype=bool)
        mark[at] = True
        return np.bincount(self.owner[mark[self.place]], minlength=len(self.ids))


def _top(root: dict[int, int], x: int) -> int:
    while (y := root.get(x, x)) != x:
        root[x] = root.get(y, y)
        x = y
    return x


def _settle(pairs: list[DataFrame], percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links found in each pair of parts."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in batch.to_pylist():
                one = _Part(row["a_ids"], row["a_ends"], row["a_tokens"])
                same = row["b_ids"] is None
                two = one if same else _Part(row["b_ids"], row["b_ends"], row["b_tokens"])
                if not same and len(one.ids) > len(two.ids):
                    one, two = two, one
                two.united()
                root: dict[int, int] = {}
                for i, query in one.each():
                    size = len(query)
                    inter = two.overlaps(query, (percent * size + 99) // 100)
                    if inter is None:
                        continue
                    hits = np.flatnonzero(100 * inter >= percent * (size + two.sizes - inter))
                    for other in two.ids[hits].tolist():
                        x, y = _top(root, int(one.ids[i])), _top(root, other)
                        if x != y:
                            root[max(x, y)] = min(x, y)
                            a.append(max(x, y))
                            b.append(min(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    found = [x.mapInArrow(settle, "a long, b long") for x in pairs]
    return found[0].union(found[1]) if len(found) > 1 else found[0]
