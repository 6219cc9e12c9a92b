"""Near-duplicate vectors by dual traversal of cover trees.

Equal vectors are one point with a weight. Spark grows the upper levels of one tree per label: a
node that is still large is split among centres, its own and others more than half its radius
apart, found on a bounded sample of it; its true covering radius is then measured. The traversal
keeps a table of node pairs. A pair whose distance less both covering radii is above the link
distance is pruned, one whose distance plus both radii is within it is accepted as a whole, and
the others are replaced by the pairs of their children. Pairs of leaves are opened in tasks, one
for each pair of tiles (neighbouring leaves of bounded size), so that a leaf's vectors go once to a
task, whatever the number of its partners. A task grows a cover tree of each leaf in numpy, nested
levels whose radii at least halve, goes on with the same bounds, and settles what is left by exact
cosines in double precision.

Nothing else than counts of nodes reaches the driver. A node accepted as a whole costs one row, so
a large group of copies never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm._shared import components, durable

#: Points of a leaf at most, leaves' worth of points in a tile, points from which a node's centres are taken.
LEAF = 1024
TILE = 4
SAMPLE = 512
#: Children of a large node at least, where its points allow as many; parts of one whose points have one direction.
PARTS = 16
#: Points of a node that no task splits further, and floating-point error allowed to bounds.
SMALL = 16
SLACK = 1e-7


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    leaf: int = LEAF,
) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept``.

    Two vectors link when their labels are equal and not null and their cosine is at least
    ``threshold`` (above 0). A vector that is null, empty, zero or holds a null or non-finite
    component links with nothing, nor does one without a label or id, nor do vectors of different
    lengths. The id names a vector: repeated rows of an id count as further vectors of its class.
    A row without an id has no component and is not kept. Other columns are ignored.
    """
    sound = F.expr(
        "id is not null and label is not null and size(v) > 0"
        " and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        " and exists(v, x -> x <> 0)"
    )
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vec_col).cast("array<double>").alias("v"),
        F.col(label_col).cast("string").alias("label"),
    )
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    keyed = rows.select(
        "id",
        "v",
        F.concat_ws("/", F.hex("label"), F.size("v")).alias("part"),
        F.when(F.col("sound"), F.xxhash64("label", "v")).alias("k1"),
        F.when(F.col("sound"), F.xxhash64(F.reverse("v"), "label")).alias("k2"),
    )
    points = durable(
        keyed.where("k1 is not null")
        .groupBy("k1", "k2")
        .agg(F.min("id").alias("id"), F.count("*").alias("w"), F.first("v").alias("v"), F.first("part").alias("node"))
    )
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    tree, placed = _grow(points, leaf)
    opened, whole = _traverse(tree, reach)
    found = _open(opened, placed, _tiles(tree, placed, TILE * leaf), threshold, reach)
    counts, edges = _merge(found, whole, placed)
    roots = components(edges)
    classes = (
        points.select("k1", "k2", "id", "w")
        .join(counts, "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "k1",
            "k2",
            (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"),
            F.coalesce("root", "id").alias("component_id"),
        )
    )
    salted = [F.coalesce(c, F.col("id"), F.lit(0)) for c in ("k1", "k2")]
    out = keyed.select("id", salted[0].alias("k1"), salted[1].alias("k2")).join(classes, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _unit(lists: pa.ChunkedArray) -> np.ndarray:
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    x = np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _apart(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - centre) ** 2).sum(axis=1))


def _net(x: np.ndarray, radius: float, first: int = 0, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres more than ``radius`` apart, the nearest of them to each point and its distance.

    With ``most`` centres at most, some points may lie farther than the radius from all of them.
    """
    far, pick, chosen, new = np.full(len(x), np.inf), np.zeros(len(x), dtype=int), [], first
    while True:
        d = _apart(x, x[new])
        pick[d < far] = len(chosen)
        far = np.minimum(far, d)
        chosen.append(new)
        left = np.flatnonzero(far > radius)
        if not len(left) or len(chosen) == most:
            return np.array(chosen), pick, far
        new = int(left[0])


def _grow(points: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (level, node, parent, centre, radius, n, w, least) and points with their leaf.

    The name of a node is the name of its parent, a dot and a number. All nodes of a level are
    listed: one that is not split is its own only child.
    """
    placed = points.select("id", "w", F.col("v"), "node", F.lit(None).cast("string").alias("parent"))
    levels, level = [], 0
    # any unit vector serves as the centre of a root: no other lies farther from it than 2
    placed = placed.withColumns({"dist": F.lit(2.0), "centre": F.expr("transform(v, (x, i) -> if(i = 0, 1d, 0d))")})
    while True:
        nodes = durable(
            placed.groupBy("node", "parent").agg(
                F.max("dist").alias("radius"),
                F.count("*").alias("n"),
                F.sum("w").alias("w"),
                F.min("id").alias("least"),
                F.first("centre").alias("centre"),
            )
        ).withColumn("level", F.lit(level))
        levels.append(nodes)
        large = nodes.where(F.col("n") > leaf)
        if not large.take(1):
            break
        placed, level = durable(_split(placed, large, leaf)), level + 1
    tree = levels[0]
    for nodes in levels[1:]:
        tree = tree.union(nodes)
    return tree, placed.select("id", "w", "v", "node")


def _split(placed: DataFrame, large: DataFrame, leaf: int) -> DataFrame:
    sizes = large.select("node", "n", "radius")
    some = placed.join(sizes, "node").where(
        F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.ceil(F.lit(float(SAMPLE << 20)) / F.col("n"))
    )

    def centres(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", key=lambda s: pd.util.hash_array(s.to_numpy()))
        x = _unit(pa.array(frame["v"].tolist(), pa.list_(pa.float64())))
        if "." in frame["node"].iloc[0]:  # a root's centre is no point; all others stay centres below
            x = np.vstack([np.array(frame["centre"].iloc[0]), x])
        most = int(min(max(PARTS, 2 * frame["n"].iloc[0] // leaf), SAMPLE))
        net = _net(x, float(frame["radius"].iloc[0]) / 2, most=most)[0]
        if len(net) < 2:  # one ball of half the radius holds the sample: take what lies farthest too
            net = _net(x, 0.0, most=most)[0]
        return pd.DataFrame({"node": [frame["node"].iloc[0]], "centres": [x[net].ravel().tolist()]})

    nets = some.select("node", "id", "v", "radius", "n", "centre").groupBy("node").applyInPandas(centres, "node string, centres array<double>")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_pandas()
            parent, dist, centre = batch.column("node").to_pylist(), np.zeros(len(node)), [None] * len(node)
            name = list(parent)
            old_dist, old_centre = batch.column("dist").to_numpy(zero_copy_only=False), batch.column("centre")
            for _, rows in node.groupby(node).indices.items():
                nets_of = batch.column("centres")[int(rows[0])].as_py()
                if nets_of is None:
                    for i in rows:
                        dist[i], centre[i] = old_dist[i], old_centre[int(i)].as_py()
                    continue
                x = _unit(batch.column("v").take(pa.array(rows)))
                c = np.array(nets_of).reshape(-1, x.shape[1])
                if len(c) == 1:  # nothing but one direction: equal parts, any of them
                    deep = PARTS ** (parent[int(rows[0])].count(".") % 15)
                    part = pd.util.hash_array(batch.column("id").to_numpy()[rows]) // np.uint64(deep) % np.uint64(PARTS)
                    d = np.sqrt(((x - c[0]) ** 2).sum(axis=1))
                    pick = np.zeros(len(rows), dtype=int)
                else:
                    every = np.sqrt(np.maximum(0, 2 - 2 * (x @ c.T)))
                    pick = part = every.argmin(axis=1)
                    d = np.sqrt(((x - c[pick]) ** 2).sum(axis=1))
                for i, k, p, r in zip(rows, pick, part, d, strict=True):
                    name[i], dist[i], centre[i] = f"{parent[i]}.{p}", r, c[k].tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("w"), batch.column("v"), pa.array(name), pa.array(parent), pa.array(dist), pa.array(centre, pa.list_(pa.float64()))],
                ["id", "w", "v", "node", "parent", "dist", "centre"],
            )

    joined = placed.select("id", "w", "v", "node", "dist", "centre").join(nets, "node", "left")
    return joined.mapInArrow(assign, "id long, w long, v array<double>, node string, parent string, dist double, centre array<double>")


def _traverse(tree: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of leaves to open and pairs of nodes that link as a whole, by the levels of the tree."""
    spark = tree.sparkSession
    depth = tree.agg(F.max("level")).first()[0]
    side = lambda level, x: tree.where(F.col("level") == level).select(*[F.col(c).alias(f"{x}_{c}") for c in ("node", "parent", "centre", "radius", "w", "least")])
    apart = F.expr("sqrt(aggregate(zip_with(a_centre, b_centre, (x, y) -> (x - y) * (x - y)), 0d, (s, x) -> s + x))")
    whole = spark.createDataFrame([], "a string, b string, a_w long, b_w long, a_least long, b_least long")
    pairs = None
    for level in range((depth if depth is not None else -1) + 1):
        a, b = side(level, "a"), side(level, "b")
        if pairs is None:
            pairs = a.join(b, F.col("a_node") == F.col("b_node"))
        else:
            pairs = pairs.join(a, F.col("a_parent") == F.col("a")).join(b, F.col("b_parent") == F.col("b")).where("a <> b or a_node <= b_node")
        pairs = pairs.withColumn("d", F.when(F.col("a_node") == F.col("b_node"), F.lit(0.0)).otherwise(apart))
        pairs = durable(
            pairs.where(F.col("d") - F.col("a_radius") - F.col("b_radius") <= reach + SLACK)
            .withColumn("all", F.col("d") + F.col("a_radius") + F.col("b_radius") <= reach - SLACK)
            .select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "a_w", "b_w", "a_least", "b_least", "all")
        )
        whole = whole.union(pairs.where("all").drop("all"))
        pairs = pairs.where("not all").select("a", "b")
    if pairs is None:
        pairs = whole.select("a", "b")
    return pairs, whole


class CoverTree:
    """A cover tree over unit vectors.

    The points of a node lie within its radius of its centre, a point. Its children's centres are its
    own and others more than half its radius apart, as many as it takes for each point to lie within
    half the radius of one. ``order[start[k] : stop[k]]`` are the points of node k.
    """

    def __init__(self, x: np.ndarray, small: int = SMALL):
        self.x, self.order, self.children = x, np.arange(len(x)), []
        centre, start, stop, radius = [0], [0], [len(x)], [float(_apart(x, x[0]).max())]
        while len(self.children) < len(centre):
            k = len(self.children)
            lo, hi = start[k], stop[k]
            self.children.append(np.array([k]))
            if hi - lo > small and radius[k] > SLACK:
                rows = self.order[lo:hi].copy()
                net, pick, far = _net(x[rows], radius[k] / 2, first=int(np.flatnonzero(rows == centre[k])[0]))
                by = pick.argsort(kind="stable")
                cuts = np.searchsorted(pick[by], np.arange(len(net) + 1))
                self.children[k] = np.arange(len(centre), len(centre) + len(net))
                self.order[lo:hi] = rows[by]
                centre += rows[net].tolist()
                start += (lo + cuts[:-1]).tolist()
                stop += (lo + cuts[1:]).tolist()
                radius += np.maximum.reduceat(far[by], cuts[:-1]).tolist()
        self.centre, self.start, self.stop, self.radius = np.array(centre), np.array(start), np.array(stop), np.array(radius)
        self.size = self.stop - self.start
        self.split = np.array([len(c) > 1 for c in self.children])

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.start[node] : self.stop[node]]


def _links(a: CoverTree, b: CoverTree | None, threshold: float, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Links of points of a with those of b (within a if None), in blocks, each once.

    (i, j, False) links i[k] with j[k], (i, j, True) all of i with all others of j.
    """
    own = b is None
    b = a if own else b
    todo, last = [(np.zeros(1, dtype=int), np.zeros(1, dtype=int), own)], []
    while todo:
        p, q, same = todo.pop()
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * (a.x[a.centre[p]] @ b.x[b.centre[q]].T)))
        both = a.radius[p][:, None] + b.radius[q][None, :]
        near, whole = apart - both <= reach + SLACK, apart + both <= reach - SLACK
        if same:
            near = np.triu(near)
            whole = whole | np.diag(both.diagonal() <= reach - SLACK)
        i, j = np.nonzero(near & whole)
        one = (a.size[p[i]] == 1) & (b.size[q[j]] == 1)
        apart_ = ~(same & (i == j))
        yield a.order[a.start[p[i[one & apart_]]]], b.order[b.start[q[j[one & apart_]]]], False
        for k, m in zip(p[i[~one]], q[j[~one]], strict=True):
            yield a.rows(k), b.rows(m), True
        i, j = np.nonzero(near & ~whole)
        done = ~a.split[p[i]] & ~b.split[q[j]]
        last.append((p[i[done]], q[j[done]]))
        todo += [(a.children[p[k]], b.children[q[m]], same and k == m) for k, m in zip(i[~done], j[~done], strict=True)]
        if not todo or sum(len(k[0]) for k in last) > 1 << 20:
            yield from _cosines(a, b, own, np.concatenate([k[0] for k in last]), np.concatenate([k[1] for k in last]), threshold)
            last = []


def _cosines(a: CoverTree, b: CoverTree, own: bool, p: np.ndarray, q: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Links between the points of nodes p[k] and q[k], by their cosines."""
    many = a.size[p] * b.size[q]
    most = max(1, (1 << 22) // a.x.shape[1])
    for k in np.flatnonzero(many > most):
        x, y = a.rows(p[k]), b.rows(q[k])
        i, j = np.nonzero(a.x[x] @ b.x[y].T >= threshold)
        keep = i < j if own and p[k] == q[k] else slice(None)
        yield x[i[keep]], y[j[keep]], False
    p, q = p[many <= most], q[many <= most]
    ends = np.cumsum(a.size[p] * b.size[q])
    at = 0
    while at < len(p):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        s, t = p[at:stop], q[at:stop]
        wide = b.size[t]
        n = a.size[s] * wide
        pair = np.repeat(np.arange(len(n)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = nth // wide[pair], nth % wide[pair]
        keep = (i < j) | (s != t)[pair] if own else slice(None)
        i, j = a.order[a.start[s][pair] + i][keep], b.order[b.start[t][pair] + j][keep]
        hit = np.einsum("ij,ij->i", a.x[i], b.x[j]) >= threshold
        yield i[hit], j[hit], False
        at = stop


def _forest(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row that each row reaches."""
    root = np.arange(n)
    i = np.concatenate([k[0] for k in links]) if links else np.zeros(0, dtype=int)
    j = np.concatenate([k[1] for k in links]) if links else np.zeros(0, dtype=int)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tiles(tree: DataFrame, placed: DataFrame, most: int) -> DataFrame:
    """(node, tile) of each leaf: tiles hold about so many points.

    The highest nodes of at most so many points are whole in a tile; it takes some of one parent.
    """
    sizes = tree.groupBy("node").agg(F.max("n").alias("n")).withColumn("parent", F.regexp_extract("node", r"^(.*)[.]", 1))
    large = sizes.where(F.col("n") > most).select(F.col("node").alias("parent"), F.ceil(F.col("n") / most).alias("parts"))
    part = F.pmod(F.xxhash64("above"), F.coalesce("parts", F.lit(1)))
    small = sizes.where(F.col("n") <= most).select(F.col("node").alias("above"), "parent").join(large, "parent", "left")
    small = small.select("above", F.concat_ws("#", F.when(F.col("parts").isNull(), F.col("above")).otherwise(F.col("parent")), part).alias("tile"))
    leaves = placed.select("node").distinct().withColumn("above", F.explode(_above()))
    return leaves.join(small, "above").groupBy("node").agg(F.min_by("tile", F.length("above")).alias("tile"))


def _above() -> Column:
    return F.expr("transform(sequence(1, size(split(node, '[.]'))), i -> substring_index(node, '.', i))")


def _open(pairs: DataFrame, placed: DataFrame, tiles: DataFrame, threshold: float, reach: float) -> DataFrame:
    """(id, n, root): partial counts and a spanning forest of the links, from each pair of tiles."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        x = np.array(frame["v"].tolist(), dtype=np.float64)
        return pd.DataFrame({"node": [frame["node"].iloc[0]], "ids": [frame["id"].to_numpy().tobytes()], "w": [frame["w"].to_numpy().tobytes()], "x": [x.tobytes()]})

    blocks = placed.groupBy("node").applyInPandas(pack, "node string, ids binary, w binary, x binary")
    tile = lambda side: tiles.select(F.col("node").alias(side), F.col("tile").alias(f"tile_{side}"))
    pairs = pairs.join(tile("a"), "a").join(tile("b"), "b").select("a", "b", F.least("tile_a", "tile_b").alias("t"), F.greatest("tile_a", "tile_b").alias("u"))
    pairs = durable(pairs)
    wanted = pairs.select(F.col("t").alias("one"), F.col("u").alias("two"), F.explode(F.array("a", "b")).alias("node")).distinct()

    def settle(leaves: pd.DataFrame, opened: pd.DataFrame) -> pd.DataFrame:
        trees, first, ids, w, at = {}, {}, [], [], 0
        for leaf in leaves.itertuples():
            ids.append(np.frombuffer(leaf.ids, np.int64))
            w.append(np.frombuffer(leaf.w, np.int64))
            x = np.frombuffer(leaf.x, np.float64).reshape(len(ids[-1]), -1)
            trees[leaf.node] = CoverTree(_unit(pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1])))
            first[leaf.node], at = at, at + len(x)
        ids, w = np.concatenate(ids), np.concatenate(w)
        order = np.argsort(ids)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(ids))
        n, links, held = np.zeros(len(ids), dtype=np.int64), [], 0
        for pair in opened.itertuples():
            own = pair.a == pair.b
            for i, j, whole in _links(trees[pair.a], None if own else trees[pair.b], threshold, reach):
                i, j = i + first[pair.a], j + first[pair.b]
                if whole:
                    if i[0] == j[0]:
                        n[i] += w[i].sum() - w[i]
                    else:
                        n[i] += w[j].sum()
                        n[j] += w[i].sum()
                    i, j = np.concatenate([i, j]), np.concatenate([np.full(len(i), j[0]), np.full(len(j), i[0])])
                else:
                    np.add.at(n, i, w[j])
                    np.add.at(n, j, w[i])
                links.append((rank[i], rank[j]))
                held += len(i)
                if held > 1 << 21:  # what they span is all that is needed of links
                    links, held = [(np.arange(len(ids)), _forest(len(ids), links))], 0
        root = ids[order[_forest(len(ids), links)[rank]]]
        return pd.DataFrame({"id": ids[n > 0], "n": n[n > 0], "root": root[n > 0]})

    sides = wanted.join(blocks, "node").groupBy("one", "two"), pairs.groupBy("t", "u")
    return durable(sides[0].cogroup(sides[1]).applyInPandas(settle, "id long, n long, root long"))


def _merge(found: DataFrame, whole: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of each point to other points' vectors, and edges that span the components."""
    own = F.col("a") == F.col("b")
    per_node = (
        whole.select(F.col("a").alias("anc"), "b_w", F.col("a_least").alias("least"), own.cast("int").alias("self"))
        .union(whole.where(~own).select(F.col("b").alias("anc"), F.col("a_w"), F.col("b_least"), F.lit(0)))
        .groupBy("anc")
        .agg(F.sum("b_w").alias("add"), F.min("least").alias("least"), F.max("self").alias("self"))
    )
    inside = placed.select("id", "w", F.explode(_above()).alias("anc")).join(per_node, "anc").select("id", (F.col("add") - F.col("self") * F.col("w")).alias("n"), F.col("least").alias("root"))
    inside = durable(inside)
    counts = found.select("id", "n").union(inside.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
    edges = (
        found.select(F.col("id").alias("a"), F.col("root").alias("b"))
        .union(inside.select("id", "root"))
        .union(whole.select("a_least", "b_least"))
    )
    return counts, edges
