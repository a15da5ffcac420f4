"""Hard-negative mining: angles to reference directions bound the scores, and only what may matter is scored in whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.session import materialize

#: Components are scaled by this before they are rounded down.
SCALE = 256.0
POSITIVES = 5
NEGATIVES = 5
#: A negative scores between four fifths of its positive's score and all of it.
SHARE = (4, 5)
#: Directions that every vector's angle is stored to.
REFERENCES = 8
#: They are chosen from about so many vectors, and so many bytes, at most.
SAMPLE, SAMPLE_BYTES = 2048, 32 << 20
#: Rows of a tile, anchors that meet a tile in one group, and tiles whose summaries are looked at together, at most.
TILE, ANCHORS, PAGE = 16_384, 16_384, 4096
#: Labels are dealt to so many kinds of tiles.
LABELS = 16
#: Pairs whose bounds are computed at a time.
PAIRS = 1 << 21
#: Radians, and share of the product of two norms, by which bounds are widened against rounding.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1

_ROW = "row long, vec_id long, label long, anchor boolean, dim int, v binary"
_STATE = f"{_ROW}, norm double, angles array<double>, cell int"


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), dim)


def whole_vectors(table: DataFrame, anchors: Column) -> DataFrame:
    """The rows that take part, with ``v``: each component times SCALE rounded down, a whole number kept as a double."""
    picked = table.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"), "embedding",
    )
    usable = picked.filter("label IS NOT NULL AND embedding IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, dims, data = [], [], []
            for k, vector in enumerate(batch.column(4)):
                values = vector.values
                if values.null_count == 0:
                    with np.errstate(over="ignore", invalid="ignore"):
                        whole = np.floor(SCALE * np.asarray(values.to_numpy(zero_copy_only=False), np.float64)) + 0.0
                    if np.isfinite(whole).all():
                        kept.append(k)
                        dims.append(len(whole))
                        data.append(whole.tobytes())
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(dims, pa.int32()), pa.array(data, pa.binary())], names=["row", "vec_id", "label", "anchor", "dim", "v"])

    return usable.mapInArrow(run, _ROW)


def unit_vectors(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at length one, and their lengths; a zero vector stays zero. No finite vector over- or underflows."""
    top = np.abs(vectors).max(axis=1, initial=0.0)
    scaled = vectors / np.where(top > 0, top, 1.0)[:, None]
    size = np.sqrt((scaled * scaled).sum(axis=1))
    with np.errstate(over="ignore"):
        return scaled / np.where(size > 0, size, 1.0)[:, None], top * size


def reference_directions(sample: np.ndarray, dim: int) -> np.ndarray:
    """Vectors of the sample that lie far from each other, one after the other; filled up with random directions."""
    units = unit_vectors(sample)[0]
    units = units[(units != 0).any(axis=1)]
    out = []
    if len(units):
        nearest = np.full(len(units), -np.inf)
        at = 0
        while len(out) < min(REFERENCES, len(units)) and nearest[at] < 0.999:
            out.append(units[at])
            nearest = np.maximum(nearest, units @ units[at])
            at = int(nearest.argmin())
    rest = np.random.default_rng(dim).standard_normal((REFERENCES - len(out), dim))
    return np.concatenate([np.array(out).reshape(len(out), dim), unit_vectors(rest)[0]])


def score_bounds(angles, norms, low_angles, high_angles, low_norms, high_norms) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds of the scores of some vectors (rows) with others whose angles and norms lie in a range (columns).

    Two vectors at angles s and t to a direction are between |s - t| and min(s + t, 2 pi - s - t) apart; over all directions the
    narrowest range counts. Its cosines times the norms bound the score, widened so that rounding cannot cut off a true one.
    A bound that is not a number bounds nothing.
    """
    near, far = np.zeros((len(angles), len(low_angles))), np.full((len(angles), len(low_angles)), np.pi)
    for r in range(angles.shape[1]):
        own, low, high = angles[:, r, None], low_angles[None, :, r], high_angles[None, :, r]
        np.maximum(near, np.maximum(low - own, own - high), out=near)
        np.minimum(far, np.minimum(own + high, 2 * np.pi - own - low), out=far)
    upper, lower = np.cos(np.maximum(near - ANGLE_SLACK, 0.0)), np.cos(np.minimum(far + ANGLE_SLACK, np.pi))
    with np.errstate(over="ignore", invalid="ignore"):
        small, large = norms[:, None] * low_norms[None, :], norms[:, None] * high_norms[None, :]
        slack = SCORE_SLACK * large + 1e-3
        upper = np.where(upper > 0, large, small) * upper + slack
        lower = np.where(lower > 0, small, large) * lower - slack
    return np.clip(upper, -(2.0**63), 2.0**63), np.clip(lower, -(2.0**63), 2.0**63)


def exact_scores(vectors: np.ndarray, norms: np.ndarray, one: np.ndarray, norm: float) -> np.ndarray:
    """Inner products in whole numbers, cut to 64 bits."""
    with np.errstate(over="ignore"):
        most = norm * norms.max(initial=0.0)
    if most < 1 << 52:  # every partial sum is a whole number that a double holds
        return (vectors @ one).astype(np.int64)
    whole = [int(x) for x in one]
    sums = [sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in vectors]
    return np.array([min(max(s, LOWEST), HIGHEST) for s in sums], np.int64)


def _first(ids: np.ndarray, known: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, ~known, -scores.astype(object) if len(scores) and scores.min() == LOWEST else -scores))[:k]


class _Side:
    """Rows of a group as arrays."""

    def __init__(self, table: pa.Table):
        self.row, self.label, self.norm = (table.column(c).to_numpy() for c in ("row", "label", "norm"))
        ids = table.column("vec_id")
        self.known, self.ids = ids.is_valid().to_numpy(), ids.fill_null(0).to_numpy()
        self.angles = np.array(table.column("angles").to_pylist(), np.float64).reshape(len(self.row), -1)
        self.vectors = _matrix(table.column("v"), table.column("dim")[0].as_py())


def _found(rows: list[tuple], names: list[str]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)


def _pairs(left: _Side, right: _Side) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor its number and the bounds of its scores."""
    step = max(1, PAIRS // max(1, len(right.row)))
    for a in range(0, len(left.row), step):
        part = slice(a, a + step)
        upper, lower = score_bounds(left.angles[part], left.norm[part], right.angles, right.angles, right.norm, right.norm)
        for i in range(len(upper)):
            yield a + i, upper[i], lower[i]


def _find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
    """The first rows of a tile for each anchor, among those of its label whose bound reaches its floor."""
    out = []
    if left.num_rows and right.num_rows:
        anchors, rows, floor = _Side(left), _Side(right), left.column("floor").to_numpy()
        for i, upper, _ in _pairs(anchors, rows):
            near = np.flatnonzero(~(upper < floor[i]) & (rows.label == anchors.label[i]) & (rows.row != anchors.row[i]))
            scores = exact_scores(rows.vectors[near], rows.norm[near], anchors.vectors[i], anchors.norm[i])
            for k in _first(rows.ids[near], rows.known[near], scores, POSITIVES):
                j = near[k]
                out.append((int(anchors.row[i]), int(rows.row[j]), int(rows.ids[j]) if rows.known[j] else None, int(scores[k])))
    return _found(out, ["anchor_row", "other_row", "other_id", "score"])


def _windows(scores: list[int]) -> list[tuple[int, int]]:
    """What a negative may score for each score of a positive; empty for one below zero."""
    up, down = SHARE
    return [(-(-up * s // down), s) for s in scores]


def _find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
    """The first rows of a tile in each window of each anchor, among those of other labels whose bounds meet a window."""
    out = []
    if left.num_rows and right.num_rows:
        anchors, rows = _Side(left), _Side(right)
        positives = left.column("positives").to_pylist()
        for i, upper, lower in _pairs(anchors, rows):
            windows = _windows([p["score"] for p in positives[i]])
            meets = np.zeros(len(upper), bool)
            for low, high in windows:
                if low <= high:
                    meets |= ~(upper < low) & ~(lower > high)
            near = np.flatnonzero(meets & (rows.label != anchors.label[i]))
            if not len(near):
                continue
            scores = exact_scores(rows.vectors[near], rows.norm[near], anchors.vectors[i], anchors.norm[i])
            for place, (low, high) in enumerate(windows):
                inside = np.flatnonzero((scores >= low) & (scores <= high))
                for k in inside[_first(rows.ids[near[inside]], rows.known[near[inside]], scores[inside], NEGATIVES)]:
                    j = near[k]
                    out.append((int(anchors.row[i]), place, int(rows.row[j]), int(rows.ids[j]) if rows.known[j] else None, int(scores[k])))
    return _found(out, ["anchor_row", "place", "other_row", "other_id", "score"])


def _tiles_to_visit(negatives: bool):
    """(anchor, tile) for a block of anchors and a page of tile summaries, where the bounds of the tile allow a result."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_rows, out_tiles = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            rows, label, norm, dim, own = (left.column(c).to_numpy() for c in ("row", "label", "norm", "dim", "tile"))
            angles = np.array(left.column("angles").to_pylist(), np.float64)
            tile, of_dim, low_norm, high_norm, low_label, high_label = (right.column(c).to_numpy() for c in ("tile", "of_dim", "low_norm", "high_norm", "low_label", "high_label"))
            low, high = (np.array(right.column(c).to_pylist(), np.float64) for c in ("low_angles", "high_angles"))
            if negatives:
                windows = [[w for w in _windows([p["score"] for p in ps]) if w[0] <= w[1]] for ps in left.column("positives").to_pylist()]
            else:
                floor = left.column("floor").to_numpy()
            step = max(1, PAIRS // len(tile))
            for a in range(0, len(rows), step):
                part = slice(a, a + step)
                upper, lower = score_bounds(angles[part], norm[part], low, high, low_norm, high_norm)
                for i in range(len(upper)):
                    k = a + i
                    if negatives:
                        wanted = np.zeros(len(tile), bool)
                        for least, most in windows[k]:
                            wanted |= ~(upper[i] < least) & ~(lower[i] > most)
                        wanted &= (low_label != label[k]) | (high_label != label[k])
                    else:
                        wanted = ~(upper[i] < floor[k]) & (low_label <= label[k]) & (high_label >= label[k]) & (tile != own[k])
                    hit = tile[wanted & (of_dim == dim[k])]
                    out_rows.append(np.full(len(hit), rows[k]))
                    out_tiles.append(hit)
        return pa.Table.from_arrays([pa.array(np.concatenate(out_rows)), pa.array(np.concatenate(out_tiles))], names=["row", "tile"])

    return run


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other_row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _with_angles(rows: DataFrame) -> DataFrame:
    """Add the norm, the angles to the references and the cell (nearest reference and kind of label)."""
    common = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common["dim"] if common else 0
    size = max(1, min(SAMPLE, SAMPLE_BYTES // max(1, 8 * dim)))
    chosen = rows.filter(F.col("dim") == dim).select("v").orderBy(F.xxhash64("v"), "v").limit(size).collect()
    known = {dim: reference_directions(np.array([np.frombuffer(r["v"], np.float64) for r in chosen]).reshape(len(chosen), dim), dim)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for d in np.unique(batch.column(4).to_numpy()).tolist():
                part = table.filter(pa.compute.equal(table.column("dim"), d))
                directions = known[d] if d in known else reference_directions(np.zeros((0, d)), d)
                units, norms = unit_vectors(_matrix(part.column("v"), d))
                cosines = np.clip(units @ directions.T, -1.0, 1.0)
                cell = cosines.argmax(axis=1) * LABELS + part.column("label").to_numpy() % LABELS
                angles = np.arccos(cosines)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1) * REFERENCES, pa.int32()), pa.array(angles.ravel()))
                extra = [pa.array(norms), lists, pa.array(cell, pa.int32())]
                yield from pa.Table.from_arrays([*part.columns, *extra], names=[*part.column_names, "norm", "angles", "cell"]).to_batches()

    return rows.mapInArrow(run, _STATE)


def hard_negatives(table: DataFrame, anchors: Column) -> DataFrame:
    """Hard negatives for the rows of ``table`` (``vec_id``, ``embedding``, ``label``) for which ``anchors`` is true.

    Returns ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``. A score is the inner product of two
    vectors, components times SCALE rounded down. The positives of an anchor are the POSITIVES other rows of its label with
    the highest scores; the negatives of a positive the NEGATIVES rows of other labels with the highest scores between
    SHARE of its score and its score. Equal scores go by smaller ``vec_id``, a null one last.

    Every row stores its angles to a few reference directions, chosen from a bounded sample, and lies in a tile of
    rows near the same direction. An anchor first searches its own tile; the score of its last positive there is a floor for the
    others. It then visits only tiles whose range of angles and norms allows a score above the floor, or, for negatives, in a
    window, and in them scores only rows whose own bounds do. Anchors meet summaries of tiles, and tiles, in
    blocks of bounded size. The result is exact.

    Rows with a null ``label`` or ``embedding``, or with a component that is null or not finite once scaled, take no part. Vectors of different
    lengths have no score with each other; a zero or empty vector scores 0. Repeated rows count each, as anchors too. A row
    without ``vec_id`` can be a result. A score beyond 64 bits counts as the nearest number within. Windows of a
    positive below zero are empty. Other columns are ignored; an empty table gives an empty result.
    """
    rows = materialize(whole_vectors(table, anchors), "negatives-vectors")
    placed = materialize(_with_angles(rows), "negatives-angles")
    cells = materialize(placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts")), "negatives-cells")
    own = F.shiftleft(F.col("cell").cast("long"), 32) + F.pmod(F.xxhash64("row"), F.col("parts"))
    tiled = materialize(placed.join(cells, ["dim", "cell"]).withColumn("tile", own).drop("cell", "parts"), "negatives-tiles")
    asking = tiled.filter("anchor").drop("anchor")
    blocks = max(1, -(-asking.count() // ANCHORS))
    asking = asking.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int"))
    ends = [f(F.col("angles")[r]) for f in (F.min, F.max) for r in range(REFERENCES)]
    summaries = tiled.groupBy(F.col("dim").alias("of_dim"), "tile").agg(
        F.array(*ends[:REFERENCES]).alias("low_angles"), F.array(*ends[REFERENCES:]).alias("high_angles"), F.min("norm").alias("low_norm"), F.max("norm").alias("high_norm"),
        F.min("label").alias("low_label"), F.max("label").alias("high_label"),
    )
    summaries = materialize(summaries, "negatives-summaries")
    pages = max(1, -(-summaries.count() // PAGE))
    numbers = F.sequence(F.lit(0), F.lit(blocks - 1))
    summaries = summaries.withColumn("page", F.pmod(F.xxhash64("of_dim", "tile"), F.lit(pages)).cast("int")).withColumn("of_block", F.explode(numbers))

    def visits(asked: DataFrame, negatives: bool) -> DataFrame:
        spread = asked.drop("v").withColumn("of_page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
        pairs = spread.groupBy("block", "of_page").cogroup(summaries.groupBy("of_block", "page")).applyInArrow(_tiles_to_visit(negatives), "row long, tile long")
        return materialize(pairs, "negatives-visits").join(asked.drop("tile"), "row")

    def search(asked: DataFrame, find, schema: str) -> DataFrame:
        asked = materialize(asked, "negatives-asked")
        needed = materialize(asked.select("dim", "tile", "block").distinct(), "negatives-needed")
        held = tiled.join(needed, ["dim", "tile"])
        held = held.select(*(F.col(c).alias(f"of_{c}") if c in ("tile", "block") else F.col(c) for c in held.columns), F.col("dim").alias("of_dim"))
        return materialize(asked.groupBy("dim", "tile", "block").cogroup(held.groupBy("of_dim", "of_tile", "of_block")).applyInArrow(find, schema), "negatives-found")

    columns = "anchor_row long, other_row long, other_id long, score long"
    near = search(asking.withColumn("floor", F.lit(LOWEST)), _find_positives, columns)
    floors = near.groupBy("anchor_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= POSITIVES)
    floored = asking.join(floors.select(F.col("anchor_row").alias("row"), "least"), "row", "left").withColumn("floor", F.coalesce("least", F.lit(LOWEST))).drop("least")
    floored = materialize(floored, "negatives-floors")
    far = search(visits(floored, False), _find_positives, columns)
    positives = materialize(_ranked(near.unionByName(far), ["anchor_row"], POSITIVES), "negatives-positives")
    chosen = positives.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("rank", "other_id", "score"))).alias("positives"))
    windowed = materialize(asking.join(chosen.withColumnRenamed("anchor_row", "row"), "row"), "negatives-windows")
    found = search(visits(windowed, True), _find_negatives, "anchor_row long, place long, other_row long, other_id long, score long")
    ranked = _ranked(found, ["anchor_row", "place"], NEGATIVES).select("anchor_row", "place", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    sides = windowed.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("place", "positive"))
    sides = sides.select("anchor_row", F.col("place").cast("long").alias("place"), "anchor_id", F.col("positive.other_id").alias("positive_id"), F.col("positive.score").alias("positive_score"))
    return ranked.join(sides, ["anchor_row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
