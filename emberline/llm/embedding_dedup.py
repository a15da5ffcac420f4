"""Embedding near-dedup: a forest of random-projection trees with overlap proposes pairs, cosines decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.components import components
from emberline.session import broadcast_if_small, materialize

#: Vectors link from this cosine on.
MIN_COSINE = 0.9
TREES = 6
#: A leaf holds about so many vectors, unless they lie too close together to be split.
LEAF = 1000
#: The trees are fitted on about so many vectors and so many bytes at most, chosen by hash; every vector is sent through them.
SAMPLE, SAMPLE_BYTES = 40_000, 64 << 20
#: So many lengths of vectors get trees, the most common ones with more vectors than a leaf; any other length is one leaf.
LENGTHS = 64
#: Leaves that the vectors of a tile are compared by at a time.
SHARED = 4096
#: A node is not split further below so many vectors of the sample.
SAMPLE_LEAF = 12
#: Width of the overlap to either side of a split, in standard deviations of the projected difference of a pair at
#: MIN_COSINE. Vectors within go down both sides.
SPILL = 0.5
#: A node whose larger side keeps more than this share is a leaf.
SHRINK = 0.9
#: A node is not split if both sides together hold more than this many times its rows, as those of a dense group would.
GROWTH = 1.4
#: Nor if the growths on the way from the root multiply to more than this, so that a tree holds at most so many rows a vector
#: of the sample: the rows of its leaves, each divided by the product on its way, add up to the sample.
COPIES = 16
MAX_DEPTH = 40
#: Leaves that ended because the sample had no more rows are split further on all their vectors, by so many directions at most;
REFITS = 32
#: one that so many directions in a row do not part is left as it is.
REFUSALS = 4
#: A larger leaf is cut into parts of about this many vectors; each two parts meet in one tile.
TILE = 1500
#: Rows compared at a time with all others of a tile.
ROWS = 256


@dataclass
class Tree:
    """Nodes as arrays; a child below zero is the leaf ``-1 - child``. All nodes of a level share a direction."""

    directions: np.ndarray
    thresholds: np.ndarray
    low: np.ndarray
    high: np.ndarray
    level: np.ndarray
    margin: float
    #: by leaf: the growths on its way multiplied if it ended for want of rows, else NaN
    grown: np.ndarray

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each row reaches."""
        projected = vectors @ self.directions.T
        rows, nodes = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        out_rows, out_leaves = [], []
        if not len(self.low):
            return rows, nodes
        while len(rows):
            gap = projected[rows, self.level[nodes]] - self.thresholds[nodes]
            left, right = gap <= self.margin, gap > -self.margin
            rows = np.concatenate([rows[left], rows[right]])
            nodes = np.concatenate([self.low[nodes[left]], self.high[nodes[right]]])
            end = nodes < 0
            out_rows.append(rows[end])
            out_leaves.append(-1 - nodes[end])
            rows, nodes = rows[~end], nodes[~end]
        return np.concatenate(out_rows), np.concatenate(out_leaves)


def grow_tree(sample: np.ndarray, leaf: float, seed: int, margin: float) -> tuple[Tree, int]:
    """Recursive splits at the median of a random projection; also the number of leaves."""
    random = np.random.default_rng(seed)
    directions = random.standard_normal((MAX_DEPTH, sample.shape[1]))
    directions = (directions / np.linalg.norm(directions, axis=1, keepdims=True)).astype(np.float32)
    projected = sample @ directions.T
    thresholds, low, high, levels, grown, leaves = [], [], [], [], [], 0

    def grow(rows: np.ndarray, level: int, copies: float) -> int:
        nonlocal leaves
        if len(rows) > leaf and level < MAX_DEPTH:
            values = projected[rows, level]
            threshold = float(np.median(values))
            left, right = rows[values <= threshold + margin], rows[values > threshold - margin]
            growth = (len(left) + len(right)) / len(rows)
            if max(len(left), len(right)) <= SHRINK * len(rows) and growth <= GROWTH and copies * growth <= COPIES:
                node = len(thresholds)
                thresholds.append(threshold)
                levels.append(level)
                low.append(0)
                high.append(0)
                low[node], high[node] = grow(left, level + 1, copies * growth), grow(right, level + 1, copies * growth)
                return node
            return grow(rows, level + 1, copies)
        leaves += 1
        grown.append(copies if len(rows) <= leaf else np.nan)
        return -leaves

    grow(np.arange(len(sample)), 0, 1.0)
    tree = Tree(directions, np.array(thresholds, np.float32), np.array(low, np.int64), np.array(high, np.int64), np.array(levels, np.int64), margin, np.array(grown))
    return tree, leaves


def _matrix(vectors: pa.Array, dtype) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in vectors]).astype(dtype) if len(vectors) else np.zeros((0, 0), dtype)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length one; scaled by their largest component first, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=0)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _share_smaller(leaf: int, lists: pa.ListArray) -> np.ndarray:
    """Whether two vectors share a leaf with a smaller number than ``leaf``; the leaves are looked at SHARED at a time."""
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    values = lists.flatten().to_numpy()
    owner, values = owner[values < leaf], values[values < leaf]
    known, column = np.unique(values, return_inverse=True)
    shared = np.zeros((len(lists), len(lists)), bool)
    for at in range(0, len(known), SHARED):
        here = (column >= at) & (column < at + SHARED)
        holds = np.zeros((len(lists), min(SHARED, len(known) - at)), np.float32)
        holds[owner[here], column[here] - at] = 1
        shared |= holds @ holds.T > 0
    return shared


def read_vectors(table: DataFrame) -> DataFrame:
    """``vec_id``, ``v`` (float64 components as bytes) and ``key`` (their digest) per row; both null for vectors that cannot link."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, keys = [], []
            for vec_id, vector in zip(batch.column(0), batch.column(1), strict=True):
                values = vector.as_py()
                data = None
                if vec_id.is_valid and values and None not in values:
                    array = np.asarray(values, np.float64) + 0.0  # of the two zeros one
                    data = array.tobytes() if np.isfinite(array).all() and array.any() else None
                raw.append(data)
                keys.append(None if data is None else hashlib.blake2b(data, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(keys, pa.binary())], names=["vec_id", "v", "key"])

    return rows.mapInArrow(run, "vec_id long, v binary, key binary")


def _tile(min_cosine: float):
    """Compare the vectors of one tile: a row per vector with the links counted here, and edges that connect what links."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        leaf = table.column("leaf")[0].as_py()
        ids, copies, part = (table.column(c).to_numpy() for c in ("id", "copies", "own"))
        one, two = table.column("first")[0].as_py(), table.column("second")[0].as_py()
        vectors = _unit(_matrix(table.column("v").combine_chunks(), np.float64))
        shared = None
        root = np.arange(len(ids))
        links = np.zeros(len(ids), np.int64)
        for at in range(0, len(ids), ROWS):
            rows = slice(at, at + ROWS)
            near = vectors[rows] @ vectors.T >= min_cosine
            if one != two:
                near &= part[rows][:, None] != part[None, :]
            near[np.arange(near.shape[0]), np.arange(at, at + near.shape[0])] = False
            if not near.any():
                continue
            if shared is None:  # a pair that shares a leaf with a smaller number was counted there
                shared = _share_smaller(leaf, table.column("leaves").combine_chunks())
            links[rows] += (near & ~shared[rows]) @ copies
            i, j = np.nonzero(near)
            i = i + at
            while len(i):
                a, b = root[i], root[j]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while (root[root] != root).any():
                    root = root[root]
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
        out = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
        return pa.Table.from_arrays([pa.array(ids[out]), pa.array(ids[root[out]]), pa.array(links[out])], schema=schema)

    return run


def _projector(forests: dict, seed: int):
    """Rows of a leaf each: whether it may be split further, and where its vector lies on the REFITS directions of its tree."""
    schema = pa.schema([("id", pa.int64()), ("leaf", pa.int64()), ("path", pa.int64()), ("grown", pa.float64()), ("refused", pa.int32()),
                        ("margin", pa.float64()), ("open", pa.bool_()), ("p", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims = pa.compute.divide(pa.compute.binary_length(batch.column(1)), 8)
            for dim in pa.compute.unique(dims).to_pylist():
                same = batch.filter(pa.compute.equal(dims, dim))
                lists = same.column(2)
                owner, leaf = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
                grown, margin = np.full(len(leaf), np.nan), 0.0
                places = np.zeros((len(leaf), REFITS), np.float32)
                if dim in forests:
                    vectors = _unit(_matrix(same.column(1), np.float64)).astype(np.float32)
                    for number, (tree, start) in enumerate(zip(*forests[dim], strict=True)):
                        if (dim, number) not in directions:
                            drawn = np.random.default_rng((seed, dim, number)).standard_normal((REFITS, dim))
                            directions[dim, number] = (drawn / np.linalg.norm(drawn, axis=1, keepdims=True)).astype(np.float32)
                        own = (leaf >= start) & (leaf < start + len(tree.grown))
                        grown[own], margin = tree.grown[leaf[own] - start], tree.margin
                        places[own] = (vectors @ directions[dim, number].T)[owner[own]]
                opened = ~np.isnan(grown)
                counts = np.where(opened, REFITS, 0)
                p = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(places[opened].ravel()))
                ids = same.column(0).to_numpy()[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(leaf.astype(np.int64)), pa.array(np.ones(len(leaf), np.int64)), pa.array(grown),
                     pa.array(np.zeros(len(leaf), np.int32)), pa.array(np.full(len(leaf), margin)), pa.array(opened), p], schema=schema)

    return run


def _refit(routed: DataFrame, forests: dict, seed: int) -> DataFrame:
    """``routed`` with leaves of about LEAF vectors, however small a share of the vectors the sample was.

    In each round every leaf of more than LEAF vectors that the sample was too small to split is cut at the median of its
    own vectors along the next direction, by the rules that hold for the trees. Only aggregates are joined; a leaf that refuses REFUSALS
    directions, such as a dense group, stays whole and is compared in tiles.
    """
    node = ["leaf", "path"]
    members = routed.select("id", "v", "leaves").mapInArrow(
        _projector(forests, seed), "id long, leaf long, path long, grown double, refused int, margin double, open boolean, p array<float>"
    )
    members = materialize(members, "vectors-projected")
    settled = members.filter("NOT open").select("id", *node)
    active = members.filter("open").drop("open")
    for turn in range(REFITS):
        here = F.get("p", F.lit(turn))
        sizes = active.groupBy(*node).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(here, 0.5, 1000).alias("cut"), F.first("refused").alias("r"))
        large = materialize(sizes.filter((F.col("n") > LEAF) & (F.col("r") < REFUSALS)).drop("r"), "leaves-large")
        large = broadcast_if_small(large, 64)
        settled = settled.unionByName(active.join(large, node, "left_anti").select("id", *node))
        sided = active.join(large, node).withColumns({"low": here <= F.col("cut") + F.col("margin"), "high": here > F.col("cut") - F.col("margin")})
        counted = sided.groupBy(*node).agg(F.first("n").alias("n"), F.count_if("low").alias("lows"), F.count_if("high").alias("highs"), F.first("grown").alias("g"))
        counted = counted.withColumn("growth", (F.col("lows") + F.col("highs")) / F.col("n"))
        parts = (F.greatest("lows", "highs") <= SHRINK * F.col("n")) & (F.col("growth") <= GROWTH) & (F.col("g") * F.col("growth") <= COPIES)
        counted = broadcast_if_small(materialize(counted.select(*node, "growth", parts.alias("parts")), "leaves-parted"), 64)
        sides = F.array_compact(F.array(F.when(F.col("low"), 0), F.when(F.col("high"), 1)))
        moved = sided.join(counted, node).withColumn("side", F.explode(F.when(F.col("parts"), sides).otherwise(F.array(F.lit(-1)))))
        active = materialize(moved.select(
            "id", "leaf", F.when(F.col("parts"), F.col("path") * 2 + F.col("side")).otherwise(F.col("path")).alias("path"),
            F.when(F.col("parts"), F.col("grown") * F.col("growth")).otherwise(F.col("grown")).alias("grown"),
            F.when(F.col("parts"), 0).otherwise(F.col("refused") + 1).alias("refused"), "margin", "p",
        ), "leaves-active")
        if active.isEmpty():
            break
    settled = settled.unionByName(active.select("id", *node))
    number = F.col("leaf") * (1 << (REFITS + 1)) + F.col("path")
    leaves = settled.groupBy("id").agg(F.sort_array(F.collect_list(number)).alias("leaves"))  # at most COPIES for each tree
    return materialize(routed.drop("leaves").join(leaves, "id"), "vectors-refitted")


def embedding_groups(table: DataFrame, min_cosine: float = MIN_COSINE, trees: int = TREES, seed: int = 11) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` per row of ``table`` (``vec_id`` integer, ``embedding`` array of numbers).

    Vectors with a cosine of ``min_cosine`` or more in double precision link. Equal vectors are one row in the search. Random
    trees, fitted on a bounded sample, send every vector to one or more leaves each; all pairs within a leaf are compared,
    so a pair is missed only if every tree splits it by more than the overlap. A leaf with more than TILE vectors,
    such as a dense group that no split parts, is cut into tiles that meet two by two: none is dropped. A pair that shares
    several leaves is counted in the first, so only sums and connecting edges are shuffled, no pairs.

    A sample that is a small share of the vectors ends in leaves of too many of them; these are split further, round by round, on all
    the vectors they hold, so leaves do not grow with the table.

    Only vectors of one length can link; each of the LENGTHS most common lengths has its own trees, if it has more vectors than
    a leaf, and any other length is a leaf by itself. A null, empty or zero vector, and one with a null or non-finite
    component, links with nothing; so does a row without ``vec_id``, whose component is null. Vectors of any other norm link. Repeated
    rows link like any equal vectors; other columns are ignored; an empty table gives an empty result.
    """
    rows = materialize(read_vectors(table), "vectors")
    usable = rows.filter("v IS NOT NULL")
    distinct = materialize(usable.groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")), "vectors-distinct")
    lengths = distinct.groupBy((F.octet_length("v") / 8).cast("int").alias("dim")).count().filter(F.col("count") > LEAF)
    lengths = lengths.orderBy(F.desc("count"), F.desc("dim")).limit(LENGTHS).collect()
    forests: dict[int, tuple[list[Tree], list[int]]] = {}
    total, short = 0, False
    for dim, n in ((r["dim"], r["count"]) for r in lengths):
        size = max(2 * SAMPLE_LEAF, min(SAMPLE // len(lengths), SAMPLE_BYTES // (8 * dim)))
        chosen = distinct.filter((F.octet_length("v") == 8 * dim) & (F.pmod(F.xxhash64("key"), F.lit(n)) < size)).orderBy("key").select("v").collect()
        sample = _unit(np.array([np.frombuffer(r["v"], np.float64) for r in chosen]).reshape(len(chosen), dim)).astype(np.float32)
        margin = SPILL * float(np.sqrt(2 - 2 * min_cosine) / np.sqrt(dim))
        forest, starts = [], []
        short |= SAMPLE_LEAF * n > LEAF * len(sample)
        for t in range(trees):
            tree, leaves = grow_tree(sample, max(SAMPLE_LEAF, LEAF * len(sample) / n), seed + t, margin)
            forest.append(tree)
            starts.append(total)
            total += leaves
        forests[dim] = forest, starts

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pa.compute.divide(pa.compute.binary_length(batch.column(2)), 8)
            for dim in pa.compute.unique(dims).to_pylist():
                same = batch.filter(pa.compute.equal(dims, dim))
                for at in range(0, same.num_rows, 4096):
                    part = same.slice(at, 4096)
                    if dim in forests:
                        vectors = _unit(_matrix(part.column(2), np.float64)).astype(np.float32)
                        found = [(r, x + start) for tree, start in zip(*forests[dim], strict=True) for r, x in [tree.leaves(vectors)]]
                    else:
                        found = [(np.arange(part.num_rows), np.full(part.num_rows, -dim))]
                    row, leaf = (np.concatenate(x) for x in zip(*found, strict=True))
                    order = np.lexsort((leaf, row))
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))])
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(leaf[order], pa.int64()))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["id", "copies", "v", "leaves"])

    routed = materialize(distinct.select("id", "copies", "v").mapInArrow(route, "id long, copies long, v binary, leaves array<long>"), "vectors-routed")
    if short:
        routed = _refit(routed, forests, seed)
    large = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().filter(F.col("count") > TILE)
    large = broadcast_if_small(materialize(large.select("leaf", F.ceil(F.col("count") / TILE).cast("int").alias("parts")), "vectors-large"), 64)
    members = routed.select("*", F.explode("leaves").alias("leaf")).join(large, "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    members = members.withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = members.select("id", "copies", "v", "leaves", "leaf", "own", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))
    found = materialize(tiles.groupBy("leaf", "first", "second").applyInArrow(_tile(min_cosine), "u long, v long, links long"), "vectors-links")
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    groups = components(found.select("u", "v"))
    state = distinct.select("key", "id", "copies").join(links, F.col("id") == F.col("u"), "left").join(groups, F.col("id") == F.col("node"), "left")
    state = state.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    joined = rows.select("vec_id", "key").join(state, "key", "left")
    component = F.coalesce("c", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
