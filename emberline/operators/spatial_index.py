"""Cell indexes that turn spatial joins into equi-joins on a cell number.

A square that covers the whole Earth is cut into cells; at level ``n`` there are ``2**n`` cells per side. An
index keeps for each *leaf* cell of a layer an array of candidates. Crowded cells are cut further, so the
arrays stay short wherever the features lie. Each place belongs to exactly one leaf of a layer, so a probe is a left
join that neither loses nor multiplies rows. Every layer has its own leaves: a sparse layer needs few of them, however
dense the others are. Layers that are small together share a table, so that one join serves them all; its rows are the
leaves cut at each other's borders, in the order of Morton numbers.

Two indexes exist: segments in metres for the nearest feature, and polygon edges in degrees for containment.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions.geometry import PARTS_TYPE, explode_segments, parts_from_wkt, point_parts
from emberline.functions.projections import polyconic_xy
from emberline.session import BROADCAST_BYTES, broadcast_bytes, broadcast_if_small, delete_path, materialize, materialize_bucketed

_LEVEL_BIT, _COLUMN_BIT, _SLOT_BIT = 52, 26, 57
#: Level of the smallest cells; places are numbered by them.
FINEST = 26
# What lies outside the box of the cells is cut into eight sectors, leaves with the numbers -1 to -9 (-5 would be the box).
#: Largest number of places that an index may have: each costs 8 bytes in the directory that every task holds.
DIRECTORY_PLACES = BROADCAST_BYTES // 16
#: Places in a node of the directory, a power of two.
NODE = 256
#: Layers share a table up to this size, even if cutting their leaves at each other's borders more than doubles it.
SHARED_BYTES = 32 * 1024 * 1024
#: Size of a bucket of a stored index that is too large to broadcast.
BUCKET_BYTES = 64 * 1024 * 1024


def _every_second_bit(value: Column) -> Column:
    """The low 26 bits of ``value``, moved apart."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def morton(ix: Column, iy: Column) -> Column:
    """Number of a finest cell such that the cells within any larger cell are numbered one after the other."""
    return F.shiftleft(_every_second_bit(ix), 1).bitwiseOR(_every_second_bit(iy))


@dataclass(frozen=True)
class Grid:
    """A square of side ``side`` (a power of two) with its lower left corner at ``(x0, y0)``."""

    x0: float
    y0: float
    side: float

    def size(self, level: int) -> float:
        return self.side / 2**level

    def number(self, level: int, ix: Column, iy: Column) -> Column:
        return F.lit(level << _LEVEL_BIT) + ix * (1 << _COLUMN_BIT) + iy

    def finest(self, x: str, y: str) -> tuple[Column, Column]:
        """Column and row of the finest cell that holds the position in columns ``x, y``, null outside the grid."""
        size = self.size(FINEST)
        inside = " AND ".join(f"{c} >= {o!r}D AND {c} < {o + self.side!r}D" for c, o in ((x, self.x0), (y, self.y0)))
        ix, iy = (F.expr(f"CASE WHEN {inside} THEN floor(({c} - {o!r}D) / {size!r}D) END") for c, o in ((x, self.x0), (y, self.y0)))
        return ix, iy


# Wide enough for every projected longitude and latitude.
METRIC_GRID = Grid(5_000_000.0 - 2.0**25, 10_000_000.0 - 2.0**25, 2.0**26)
DEGREE_GRID = Grid(-256.0, -256.0, 512.0)


@dataclass(frozen=True)
class CellIndex:
    """Leaves of one or more layers, cut so that they are the same for all: ``place`` and one array of candidates per layer.

    ``place`` is the Morton number of a leaf's first finest cell, or the number of a sector. The leaf of a position is the
    last one whose place is not after that of the position; an array is null where its layer has nothing.
    """

    leaves: DataFrame
    grid: Grid
    layers: tuple[str, ...]
    n_cells: int
    n_entries: int
    #: west, east, south and north border of what the cells cover; None if there are no leaves for positions beyond
    box: tuple[float, float, float, float] | None = None
    #: number of buckets in which ``leaves`` is stored by ``place``, 0 if it is not
    buckets: int = 0

    #: upper estimates of the in-memory size of one candidate and one cell
    ENTRY_BYTES = 88
    CELL_BYTES = 96

    @classmethod
    def size(cls, cells: int, entries: int) -> int:
        return cells * cls.CELL_BYTES + entries * cls.ENTRY_BYTES

    def sector(self, x: str, y: str) -> Column:
        """Number of the sector beyond the box that holds the position in columns ``x, y``; null within the box."""
        if self.box is None:
            return F.lit(None).cast("bigint")
        west, east, south, north = self.box
        across = f"CASE WHEN {x} < {west!r}D THEN 0L WHEN {x} > {east!r}D THEN 2L ELSE 1L END"
        along = f"CASE WHEN {y} < {south!r}D THEN 0L WHEN {y} > {north!r}D THEN 2L ELSE 1L END"
        return F.expr(f"CASE WHEN NOT isnan({x}) AND NOT isnan({y}) THEN nullif(-1L - 3L * ({across}) - ({along}), -5L) END")

    def locate(self, points: DataFrame, x: str, y: str, out: str) -> DataFrame:
        """Add the place of the leaf that holds the position in columns ``x, y``, null if there is none.

        All places stand sorted in one array, cut into nodes of NODE places: scalar subqueries of a checked size, which are
        not copied with the rows. A level of nodes holds each first place of the nodes of the next; a binary search runs
        through one node of each.
        """
        ix, iy = self.grid.finest(x, y)
        kept = points.columns
        x26, y26, beyond, own, at, node = (f"{out}{c}" for c in "xysman")
        found = points.withColumns({x26: ix, y26: iy, beyond: self.sector(x, y)})
        number = F.when(F.col(beyond).isNull(), morton(F.col(x26), F.col(y26)))
        found = found.select(*kept, beyond, number.alias(own), F.lit(0).alias(at))
        halves = F.array(*[F.lit(1 << bit) for bit in reversed(range(NODE.bit_length() - 1))])

        def later(place: Column, step: Column) -> Column:
            return F.when(F.get(F.col(node), place + step) <= F.col(own), place + step).otherwise(place)

        depth = 1
        while NODE**depth < self.n_cells:
            depth += 1
        everything = self.leaves.filter("place >= 0").agg(F.sort_array(F.collect_list("place")).alias("p"))
        for level in reversed(range(depth)):
            firsts = f"transform(filter(sequence(0, size(p) - 1), i -> i % {NODE**level} = 0), i -> get(p, i))" if level else "p"
            nodes = f"transform(sequence(0, (size(f) - 1) div {NODE}), i -> slice(f, CAST(i * {NODE} + 1 AS INT), {NODE}))"
            held = everything.filter("size(p) > 0").select(F.expr(firsts).alias("f")).select(F.expr(nodes).alias("n")).scalar()
            found = found.withColumn(node, F.get(held, F.col(at))).withColumn(f"{at}1", F.aggregate(halves, F.lit(0), later))
            if level:
                found = found.withColumn(at, F.col(at) * NODE + F.col(f"{at}1"))
        place = F.get(F.col(node), F.col(f"{at}1"))
        found = found.select(*kept, beyond, own, place.alias(node))
        place = F.coalesce(beyond, F.when(F.col(node) <= F.col(own), F.col(node)))
        # one element, one row: Catalyst follows join keys down through projections, which would write out all of the search many times over
        return found.select(*kept, F.explode(F.array(place)).alias(out))

    @property
    def broadcastable(self) -> bool:
        return self.size(self.n_cells, self.n_entries) <= _most_bytes(self.leaves)


def _most_bytes(df: DataFrame) -> int:
    """Largest index to broadcast."""
    return min(BROADCAST_BYTES, broadcast_bytes(df.sparkSession))


def _small(cells: DataFrame) -> DataFrame:
    """A stored table of numbers by cell, to be broadcast if its count allows, so that what it is joined with is neither shuffled nor sorted."""
    return broadcast_if_small(cells, 64, _most_bytes(cells) // 4)


def _discard(spark: SparkSession, made: list[str]) -> None:
    while made:
        delete_path(spark, made.pop())


def _tasks(df: DataFrame) -> int:
    """Number of tasks for work that grows out of few rows."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _overlay(own: DataFrame, group: Sequence[str], block: int) -> DataFrame:
    """``place`` and arrays of the leaves cut at every border of a leaf of any layer; leaves of no layer have null arrays.

    ``own`` has a row for each leaf of each layer, with the array of that layer.

    A row starts where a leaf starts or ends. With several layers an array also holds for the rows that follow, up to the
    end of its leaf; all of a leaf lies in one cell of level ``block``.
    """
    level = F.shiftright("cell", _LEVEL_BIT).cast("int")
    low = (1 << _COLUMN_BIT) - 1
    tiles = own.filter("cell >= 0").select(
        "*", level.alias("level"), F.shiftright("cell", _COLUMN_BIT).bitwiseAND(F.lit(low)).alias("ix"), F.col("cell").bitwiseAND(F.lit(low)).alias("iy")
    ).withColumns({c: F.expr(f"shiftleft({c}, {FINEST} - level)") for c in ("ix", "iy")})
    tiles = tiles.withColumn("place", morton(F.col("ix"), F.col("iy"))).withColumn("until", F.expr(f"place + shiftleft(1L, 2 * ({FINEST} - level))"))
    held = [F.when(F.col(n).isNotNull(), F.struct("until", F.col(n).alias("array"))).alias(n) for n in group]
    marks = tiles.select("place", *held).unionByName(tiles.select(F.col("until").alias("place")), allowMissingColumns=True)
    cut = marks.groupBy("place").agg(*[F.first(n, ignorenulls=True).alias(n) for n in group])
    if len(group) > 1:
        before = Window.partitionBy(F.shiftright("place", 2 * (FINEST - block))).orderBy("place")
        cut = cut.select("place", *[F.last(n, ignorenulls=True).over(before).alias(n) for n in group])
    cut = cut.select("place", *[F.when(F.col(n)["until"] > F.col("place"), F.col(n)["array"]).alias(n) for n in group])
    beyond = own.filter("cell < 0").groupBy(F.col("cell").alias("place")).agg(*[F.first(n, ignorenulls=True).alias(n) for n in group])
    return cut.unionByName(beyond)


def _finish(
    flat: DataFrame, weight: str, grid: Grid, label: str, box: tuple[float, float, float, float] | None = None
) -> list[CellIndex]:
    """Store the candidates of each leaf in one row: a shared table for the small layers, one for each large layer.

    ``weight`` is the SQL expression for the entries in an array ``{a}`` of candidates.
    """
    made: list[str] = []
    # by id, the first field
    leaves = materialize(flat.groupBy("layer", "cell").agg(F.sort_array(F.collect_list("candidate")).alias("candidates")), f"{label}-leaves", made)
    level = F.shiftright("cell", _LEVEL_BIT).alias("level")
    totals = leaves.groupBy("layer", level).agg(
        F.count(F.lit(1)).alias("cells"), F.sum(F.expr(weight.format(a="candidates"))).alias("entries")
    ).collect()  # one row per layer and level
    cells: dict[str, int] = {}
    entries: dict[str, int] = {}
    for r in totals:
        cells[r["layer"]] = cells.get(r["layer"], 0) + r["cells"]
        entries[r["layer"]] = entries.get(r["layer"], 0) + r["entries"]
    sizes = {n: CellIndex.size(cells[n], entries[n]) for n in cells}
    most = _most_bytes(flat)

    def together(group: Sequence[str]) -> int:
        """Where leaves are cut at the borders of another layer, the arrays of all layers are copied."""
        rows = sum(cells[n] for n in group)
        return CellIndex.size(rows, round(rows * sum(entries[n] / cells[n] for n in group)))

    groups: list[list[str]] = [[]]
    for name in sorted(sizes, key=sizes.__getitem__):
        shared = [*groups[0], name]
        if together(shared) <= (most if len(shared) == 1 else min(most, max(SHARED_BYTES, 2 * sum(sizes[n] for n in shared)))):
            groups[0] = shared
        else:
            groups.append([name])
    indexes = []
    for group in filter(None, groups):
        rows = leaves.filter(F.col("layer").isin(group)).select("cell", *[F.when(F.col("layer") == n, F.col("candidates")).alias(n) for n in group])
        cut = _overlay(rows, group, min((r["level"] for r in totals if r["layer"] in group and r["level"] >= 0), default=0))
        weights = reduce(add, [F.coalesce(F.expr(weight.format(a=f"`{n}`")), F.lit(0)) for n in group])
        large = sum(sizes[n] for n in group) > most
        # a bucket is what a task reads of the index
        buckets = max(_tasks(flat), sum(sizes[n] for n in group) // BUCKET_BYTES) if large else 0
        cut = cut.withColumn("entries", weights)
        table = materialize_bucketed(cut, label, "place", buckets) if large else materialize(cut, label)
        exact = table.agg(F.count(F.lit(1)).alias("cells"), F.sum("entries").alias("entries")).first()
        if exact["cells"] > DIRECTORY_PLACES:
            raise ValueError(f"{exact['cells']} leaves for {', '.join(group)}; allow more candidates in a leaf (capacity)")
        indexes.append(CellIndex(table, grid, tuple(group), exact["cells"], exact["entries"], box, buckets))
    _discard(flat.sparkSession, made)
    return indexes


# ---------------------------------------------------------------------------------------------- layers


def geometry_column(df: DataFrame) -> Column:
    """``parts`` from ``geometria_wkt``, else from ``longitude`` and ``latitude``, else null."""
    if "geometria_wkt" in df.columns:
        return parts_from_wkt(F.col("geometria_wkt"))
    if {"longitude", "latitude"} <= set(df.columns):
        return point_parts(F.col("longitude"), F.col("latitude"))
    return F.lit(None).cast(PARTS_TYPE)


def layer_shapes(layers: Mapping[str, tuple[DataFrame | None, str]]) -> DataFrame | None:
    """All layers (``name -> (dimension, id column)``) as one stored table ``layer, id, parts``.

    A missing layer (``None``) contributes nothing. The table is stored because every geometry is needed several
    times and parsing its text is the expensive part.
    """
    stacked = None
    for name, (df, key) in layers.items():
        if df is None:
            continue
        rows = df.select(
            F.lit(name).alias("layer"), F.col(key).cast("bigint").alias("id"), geometry_column(df).alias("parts")
        )
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return None if stacked is None else materialize(stacked, "shapes").filter(F.col("parts").isNotNull())


def metric_segments(shapes: DataFrame) -> DataFrame:
    """Projected segments ``layer, id, x1, y1, x2, y2`` of ``shapes``."""
    flat = explode_segments(shapes, "parts", "layer", "id")
    x1, y1 = polyconic_xy(F.col("x1"), F.col("y1"))
    x2, y2 = polyconic_xy(F.col("x2"), F.col("y2"))
    return flat.select("layer", "id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


# --------------------------------------------------------------------------------------------- nearest

#: Deepest level of the nearest index; its cells are 1 m wide.
DEEPEST = FINEST
#: Width of the strip around the layers that cells cover too, as a share of their extent.
AROUND = 0.0625
#: A cell of at most STUBBORN candidates that keeps this share of its parent's is not cut.
STUBBORN = 1024
STUBBORN_SHARE = 0.75
#: Ties are decided on whole millimetres, so candidates this close are all kept.
TIE_METRES = 0.01


def candidate_distance(candidate: str, px: str, py: str) -> str:
    """SQL expression: distance from a point to an indexed segment in midpoint form."""
    c = candidate
    across = f"{px} * {c}.uy - {py} * {c}.ux - {c}.across"
    beyond = f"greatest(abs({px} * {c}.ux + {py} * {c}.uy - {c}.along) - {c}.half, 0D)"
    return f"hypot({across}, {beyond})"


def _cells(places: Sequence[tuple[int, int]]) -> Column:
    return F.expr("array(" + ", ".join(f"named_struct('ix', {i}L, 'iy', {j}L)" for i, j in places) + ")")


def _children(rows: DataFrame, factor: int) -> DataFrame:
    """Each row once per child cell: ``ix, iy`` are cut ``factor`` times along both axes."""
    step = F.explode(F.sequence(F.lit(0), F.lit(factor * factor - 1)))
    kept = [c for c in rows.columns if c not in ("ix", "iy")]
    return rows.withColumn("_k", step).select(
        *kept,
        (F.col("ix") * factor + F.floor(F.col("_k") / factor)).alias("ix"),
        (F.col("iy") * factor + F.col("_k") % factor).alias("iy"),
    )


def nearest_index(segments: DataFrame, *, capacity: int = 24) -> list[CellIndex]:
    """Indexes of ``segments`` (``layer, id, x1, y1, x2, y2`` in metres) for nearest-feature joins, exact for every position.

    A cell keeps exactly the features that can be nearest to some point in it: with ``d`` the distance
    from the cell centre and ``h`` half the cell diagonal, the nearest feature of any point in the cell
    has ``d <= min(d) + 2h``. Cells with more than ``capacity`` candidates are cut further, each child testing
    only the candidates of its parent. A cell of at most STUBBORN candidates that keeps nearly all of its parent's, as
    around a vertex that many features share, is not cut: smaller cells would hold the same.

    The cells cover a box around all layers. The way from a point outside it to its nearest feature crosses the
    border of the box, and the feature is nearest there too; so positions beyond the box need only the candidates of cells on
    the border, and of these only those on the sides that can be seen from there: one side, or two from beyond a corner. Each of
    the eight sectors is one more leaf. Identical geometries are merged first (lowest id
    wins), so stacks of copies cost one candidate.
    """
    grid = METRIC_GRID
    tasks = _tasks(segments)
    ends = F.array_sort(
        F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    )
    unique = (
        segments.withColumn("_e", ends).select(
            "layer", "id", F.col("_e")[0]["x"].alias("x1"), F.col("_e")[0]["y"].alias("y1"),
            F.col("_e")[1]["x"].alias("x2"), F.col("_e")[1]["y"].alias("y2"),
        )
        .groupBy("layer", "x1", "y1", "x2", "y2")
        .agg(F.min("id").alias("id"))
    )
    # also drops NaN; checked on the stored rows, where the coordinates are no longer long expressions
    made: list[str] = []
    active = materialize(unique, "segments", made).na.drop("any")
    box = active.agg(
        F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")),
        F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2")),
    ).first()
    if box[0] is None:
        box = (grid.x0, grid.x0, grid.y0, grid.y0)
    around = max(box[1] - box[0], box[3] - box[2], 1000.0) * AROUND
    west, east, south, north = box[0] - around, box[1] + around, box[2] - around, box[3] + around

    # one number names layer and cell: the slot of the layer stands above the bits of the cell
    names = sorted(r["layer"] for r in active.select("layer").distinct().collect())  # one row per layer
    slots = F.create_map(*[F.lit(v) for n, name in enumerate(names) for v in (name, n)]) if names else F.lit(None)

    # midpoint form: the position along and across a segment then costs one rotation per test
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    active = active.withColumn("_len", F.sqrt(dx * dx + dy * dy))
    stretched = F.col("_len") > 0
    active = active.withColumns(
        {
            "ux": F.when(stretched, dx / F.nullif(F.col("_len"), F.lit(0.0))).otherwise(1.0),
            "uy": F.when(stretched, dy / F.nullif(F.col("_len"), F.lit(0.0))).otherwise(0.0),
            "mx": (F.col("x1") + F.col("x2")) / 2,
            "my": (F.col("y1") + F.col("y2")) / 2,
        }
    ).select(
        (F.try_element_at(slots, F.col("layer")) if names else F.lit(0)).cast("bigint").alias("slot"),
        F.struct(
            "id", "ux", "uy",
            (F.col("mx") * F.col("ux") + F.col("my") * F.col("uy")).alias("along"),
            (F.col("mx") * F.col("uy") - F.col("my") * F.col("ux")).alias("across"),
            (F.col("_len") / 2).alias("half"),
        ).alias("candidate"),
    )
    # a few cells cover the box to start with
    extent = max(east - west, north - south, 1.0)
    start = min(max(math.ceil(math.log2(grid.side / extent)), 0), DEEPEST - 2)
    size = grid.size(start)
    columns = range(math.floor((west - grid.x0) / size), math.floor((east - grid.x0) / size) + 1)
    rows = range(math.floor((south - grid.y0) / size), math.floor((north - grid.y0) / size) + 1)
    first = active.select("*", F.lit(None).cast("bigint").alias("of"), F.inline(_cells([(ix, iy) for ix in columns for iy in rows])))
    kids = _children(first.repartition(tasks, "ix", "iy", "candidate.id"), 4)
    finished: list[DataFrame] = []
    for level in range(start + 2, DEEPEST + 1, 2):
        size = grid.size(level)
        left, low = F.col("ix") * size + grid.x0, F.col("iy") * size + grid.y0
        covered = kids.filter((left <= east) & (left + size >= west) & (low <= north) & (low + size >= south))
        measured = covered.withColumns({"_cx": left + size / 2, "_cy": low + size / 2}).select(
            "candidate", "ix", "iy", "of", F.expr(candidate_distance("candidate", "_cx", "_cy")).alias("_d"),
            F.struct((left < west).alias("west"), (left + size > east).alias("east"), (low < south).alias("south"), (low + size > north).alias("north")).alias("border"),
            (F.col("slot") * (1 << _SLOT_BIT) + grid.number(level, F.col("ix"), F.col("iy"))).alias("place"),
        )
        reach = size * math.sqrt(2) * (1 + 1e-9) + TIE_METRES
        # stored, so that its true size decides how it is joined
        closest = materialize(measured.groupBy("place").agg(F.min("_d").alias("_min")), f"closest-{level}", made)
        kept = materialize(
            measured.join(_small(closest), "place").filter(F.col("_d") <= F.col("_min") + reach).drop("_d", "_min"), f"nearest-{level}", made
        )
        counted = kept.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.first("of").alias("of"))
        stubborn = (F.col("n") <= STUBBORN) & (F.col("n") >= STUBBORN_SHARE * F.coalesce("of", F.lit(1 << 40)))
        crowded = materialize(counted.filter((F.col("n") > capacity) & ~stubborn).select("place", "n"), f"crowded-{level}", made)
        if level + 2 > DEEPEST or crowded.isEmpty():
            finished.append(kept)
            break
        crowded = _small(crowded)
        finished.append(kept.join(crowded, "place", "left_anti"))
        # every row is about to be multiplied: spread the rows over all tasks first
        active = kept.join(crowded, "place").select(
            "candidate", "ix", "iy", F.col("n").alias("of"), F.shiftright("place", _SLOT_BIT).alias("slot")
        )
        kids = _children(active.repartition(tasks, "ix", "iy", "candidate.id"), 4)

    flat = finished[0]
    for more in finished[1:]:
        flat = flat.unionByName(more)
    flat = flat.select(
        F.get(F.array(*[F.lit(n) for n in names or [""]]), F.shiftright("place", _SLOT_BIT).cast("int")).alias("layer"),
        F.col("place").bitwiseAND(F.lit((1 << _SLOT_BIT) - 1)).alias("cell"),
        "candidate", "border",
    )
    # a side of the box serves the sectors that lie beyond its line
    sectors = F.expr(
        "concat(if(border.west, array(-1, -2, -3), array()), if(border.east, array(-7, -8, -9), array()),"
        " if(border.south, array(-1, -4, -7), array()), if(border.north, array(-3, -6, -9), array()))"
    )
    beyond = flat.select("layer", F.explode(sectors.cast("array<bigint>")).alias("cell"), "candidate").distinct()
    flat = flat.drop("border").unionByName(beyond)
    indexes = _finish(flat, "size({a})", grid, "nearest-index", (west, east, south, north))
    _discard(segments.sparkSession, made)
    return indexes


# ----------------------------------------------------------------------------------------- containment
#
# A point is inside a polygon if the ray from it to +x crosses an odd number of edges. Only the edges of its own cell
# are needed for that: walk from the point along the ray to the right border of the cell, then down the border to the
# cell's lower right corner, and flip the known answer for that corner at every edge on the way. Edges are compared
# with half-open rules (greater / not greater), and an edge that passes close to the bend of the walk is judged
# once for both legs, so rounding cannot make the two legs disagree.

#: First level of the containment index (1 degree cells) and the levels it may be refined to.
CONTAINMENT_LEVELS = tuple(range(9, 26, 2))
#: Rounding slack in degrees when edges are assigned to cells.
SLACK = 1e-9

_EDGE = ("x1", "y1", "x2", "y2")


def polygon_edges(shapes: DataFrame) -> DataFrame:
    """Edges of polygon ``shapes`` with the westernmost longitude of their polygon.

    Of polygons with the same geometry in a layer only the one with the lowest id is kept: it wins anyway.
    """
    unique = shapes.groupBy("layer", "parts").agg(F.min("id").alias("id"))
    rows = unique.select(
        "layer", "id", "parts", F.array_min(F.flatten(F.flatten("parts"))["x"]).alias("west")
    )
    return explode_segments(rows, "parts", "layer", "id", "west").drop("part", "ring")


def ray_meets(e: str, x: str, y: str) -> str:
    """SQL condition: the edge straddles the height ``y`` and lies right of ``x`` there."""
    at = f"({e}x2 - {e}x1) * ({y} - {e}y1) / nullif({e}y2 - {e}y1, 0D) + {e}x1"
    return f"(({e}y1 > {y}) <> ({e}y2 > {y}) AND {x} < {at})"


def border_above(e: str, right: str, y: str) -> str:
    """SQL condition for an edge that crosses the line ``x = right``: it does so above the height ``y``.

    Where the edge straddles the height too, the answer follows from ``ray_meets`` and the slope.
    """
    rising = f"(({e}x2 > {e}x1) = ({e}y2 > {e}y1))"
    return f"(CASE WHEN ({e}y1 > {y}) <> ({e}y2 > {y}) THEN {ray_meets(e, right, y)} <> {rising} ELSE {e}y1 > {y} END)"


def walk_flips(e: str, px: str, py: str, right: str, crosses: str, corner_below: str) -> str:
    """SQL expression 0, 1 or 2: how often the walk from the point to the corner meets the edge.

    ``crosses`` tells whether the edge crosses the line of the right border, ``corner_below`` whether it does so above the
    corner.
    """
    along = f"({ray_meets(e, px, py)} AND NOT {ray_meets(e, right, py)})"
    down = f"({crosses} AND {border_above(e, right, py)} <> {corner_below})"
    return f"(CAST({along} AS INT) + CAST({down} AS INT))"


def _corner_parity(rows: DataFrame) -> DataFrame:
    """One row per cell and polygon whose lower right corner is inside."""
    return (
        rows.groupBy("layer", "id", "ix", "iy")
        .agg((F.sum("parity") % 2).cast("int").alias("parity"))
        .filter(F.col("parity") == 1)
    )


def _touching(edges: DataFrame, left: Column, low: Column, size: float) -> DataFrame:
    """Edges that touch their cell: the boxes overlap, and the corners are not all on one side of the line of the edge.

    Boxes alone would put a long slanting edge into as many cells as its box has.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    off = dx * (low + size / 2 - F.col("y1")) - dy * (left + size / 2 - F.col("x1"))
    return edges.filter(
        (F.least("x1", "x2") <= left + size + SLACK) & (F.greatest("x1", "x2") >= left - SLACK)
        & (F.least("y1", "y2") <= low + size + SLACK) & (F.greatest("y1", "y2") >= low - SLACK)
        & (F.abs(off) <= (F.abs(dx) + F.abs(dy)) * (size / 2 + SLACK))
    )


def _visible(rows: DataFrame) -> DataFrame:
    """Without the polygons that can never win in a cell, because one with a lower id covers all of it."""
    whole = rows.groupBy("layer", "cell", "id").agg(F.count("x1").alias("edges"), F.sum("parity").alias("parity"))
    lowest = whole.filter("edges = 0 AND parity % 2 = 1").groupBy("layer", "cell").agg(F.min("id").alias("_lowest"))
    return rows.join(lowest, ["layer", "cell"], "left").filter("_lowest IS NULL OR id <= _lowest").drop("_lowest")


def containment_index(
    edges: DataFrame, *, capacity: int = 24, levels: Sequence[int] = CONTAINMENT_LEVELS
) -> list[CellIndex]:
    """Indexes of polygon ``edges`` (degrees) for point-in-polygon joins.

    A cell holds the edges that touch it, and per polygon whether its lower right corner is inside. Edges are
    selected for cells, never clipped, so the test stays exact. Cells with more than ``capacity`` different edges are
    cut further.
    """
    grid = DEGREE_GRID
    tasks = _tasks(edges)
    size = grid.size(levels[0])

    def column_of(value: Column, origin: float) -> Column:
        return F.floor((value - origin) / size)

    made: list[str] = []
    start = materialize(edges.na.drop("any"), "edges", made).repartition(tasks, *_EDGE)
    banded = start.withColumn("iy", F.explode(F.sequence(
        column_of(F.least("y1", "y2") - SLACK, grid.y0), column_of(F.greatest("y1", "y2") + SLACK, grid.y0)
    )))
    touching = banded.withColumn("ix", F.explode(F.sequence(
        column_of(F.least("x1", "x2") - SLACK, grid.x0), column_of(F.greatest("x1", "x2") + SLACK, grid.x0)
    ))).drop("west")
    touching = _touching(touching, F.col("ix") * size + grid.x0, F.col("iy") * size + grid.y0, size)
    # every corner left of the edge sees it on its ray
    seen = banded.withColumn("ix", F.explode(F.sequence(
        column_of(F.col("west") - SLACK, grid.x0), column_of(F.greatest("x1", "x2") + SLACK, grid.x0)
    )))
    corner = {"_right": (F.col("ix") + 1) * size + grid.x0, "_low": F.col("iy") * size + grid.y0}
    seen = seen.withColumns(corner).filter(F.expr(ray_meets("", "_right", "_low"))).withColumn("parity", F.lit(1))
    corners = _corner_parity(seen)

    finished: list[DataFrame] = []
    columns = ["layer", "id", "ix", "iy", *_EDGE, "parity", "cell"]
    for place, level in enumerate(levels):
        size = grid.size(level)
        if place:
            parent = grid.size(levels[place - 1])
            factor = 1 << (level - levels[place - 1])
            # the parent's corner, then the corner of each child
            rows = rows.withColumns({
                "_right": (F.col("ix") + 1) * parent + grid.x0, "_low": F.col("iy") * parent + grid.y0
            })
            kids = _children(rows.repartition(tasks, "ix", "iy", *_EDGE), factor).withColumns({
                "_px": (F.col("ix") + 1) * size + grid.x0, "_py": F.col("iy") * size + grid.y0
            })
            crosses = "((x1 > _right) <> (x2 > _right))"
            flips = F.expr(walk_flips("", "_px", "_py", "_right", crosses, border_above("", "_right", "_low")))
            is_edge = F.col("x1").isNotNull()
            corners = _corner_parity(kids.withColumn("parity", F.when(is_edge, flips).otherwise(F.col("parity"))))
            touching = _touching(kids.filter(is_edge), F.col("_px") - size, F.col("_py"), size)
        nothing = [F.lit(None).cast("double").alias(c) for c in _EDGE]
        both = touching.select("layer", "id", "ix", "iy", *_EDGE, F.lit(0).alias("parity")).unionByName(
            corners.select("layer", "id", "ix", "iy", *nothing, "parity")
        )
        cell = grid.number(level, F.col("ix"), F.col("iy"))
        kept = _visible(materialize(both.withColumn("cell", cell).select(*columns), f"touching-{level}", made))
        kept = materialize(kept.select(*columns), f"containment-{level}", made)
        crowded = materialize(
            kept.filter(F.col("x1").isNotNull()).groupBy("layer", "cell", *_EDGE).agg(F.lit(1).alias("_one"))
            .groupBy("layer", "cell").count().filter(F.col("count") > capacity).drop("count"),
            f"crowded-{level}", made,
        )
        if level == levels[-1] or crowded.isEmpty():
            finished.append(kept.withColumn("level", F.lit(level)))
            break
        crowded = _small(crowded)
        finished.append(kept.join(crowded, ["layer", "cell"], "left_anti").select(*columns, F.lit(level).alias("level")))
        rows = kept.join(crowded, ["layer", "cell"], "left_semi").select(*columns).drop("cell")

    flat = finished[0]
    for more in finished[1:]:
        flat = flat.unionByName(more)
    size_of = grid.side / F.pow(F.lit(2.0), F.col("level"))
    flat = flat.withColumns({"_right": (F.col("ix") + 1) * size_of + grid.x0, "_low": F.col("iy") * size_of + grid.y0})
    crosses = "((x1 > _right) <> (x2 > _right))"
    edge = F.when(
        F.col("x1").isNotNull(),
        F.struct(
            *_EDGE, F.least("y1", "y2").alias("low"), F.greatest("y1", "y2").alias("high"),
            F.expr(crosses).alias("crosses"), F.expr(f"{crosses} AND {border_above('', '_right', '_low')}").alias("above"),
        ),
    )
    polygons = flat.groupBy("cell", "layer", "id", "_right").agg(
        (F.sum("parity") % 2).cast("int").alias("parity"), F.collect_list(edge).alias("edges")
    )
    polygons = polygons.select(
        "cell", "layer", F.struct("id", "parity", F.col("_right").alias("border"), "edges").alias("candidate")
    )
    indexes = _finish(polygons, "aggregate({a}, 0, (n, p) -> n + size(p.edges) + 1)", grid, "containment-index")
    _discard(edges.sparkSession, made)
    return indexes
