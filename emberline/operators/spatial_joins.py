"""Point-in-polygon and nearest-feature joins over the cell indexes.

Every probe is one left join per group of layers plus expressions over the candidate arrays: one row in, one row
out, no Python, and no shuffle of the points while the index of a layer fits a broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.joins import bucketed_left_join, salted_left_join
from emberline.operators.spatial_index import CellIndex, candidate_distance, walk_flips

NO_ID = -1
NO_DISTANCE = -1.0

#: Weight of an edge that the point lies on; no polygon has as many edges in a cell.
_TOUCH = 1 << 24
#: Bits for the place of a candidate in its array; millimetres on Earth need 36 bits.
_PLACE_BITS = 26


def _probe(points: DataFrame, indexes: Sequence[CellIndex], layers: Sequence[str], x: str, y: str) -> DataFrame:
    """Points with the candidate arrays of their leaf, one ``_c_<layer>`` column per layer.

    One search through the directory of an index finds the leaf of a point, one join its arrays. A small index is broadcast;
    nothing is shuffled. A large one is stored in buckets, and only the points are brought to them.
    """
    for number, index in enumerate(indexes):
        wanted = [n for n in layers if n in index.layers]
        if not wanted:
            continue
        key = f"_k{number}"
        points = index.locate(points, x, y, key)
        part = index.leaves.select(F.col("place").alias(key), "entries", *[F.col(n).alias(f"_c_{n}") for n in wanted])
        if index.broadcastable:
            points = points.join(F.broadcast(part.drop("entries")), key, "left")
        elif index.buckets:
            part = part.withColumnRenamed("entries", "_entries")
            points = bucketed_left_join(points, part, key, index.buckets, F.col("_entries") * CellIndex.ENTRY_BYTES + CellIndex.CELL_BYTES)
            points = points.drop("_entries")
        else:
            points = salted_left_join(points, part.drop("entries"), [key])
        points = points.drop(key)
    return points


def _held(indexes: Sequence[CellIndex]) -> set[str]:
    return {name for index in indexes for name in index.layers}


def _containing(layer: str, px: str, py: str) -> Column:
    """Lowest id of the polygons in ``_c_<layer>`` that hold the point: on an edge, or an odd number of flips on the
    walk from the point to the corner of the cell."""
    on_edge = (
        f"{py} BETWEEN e.low AND e.high AND (e.x2 - e.x1) * ({py} - e.y1) - (e.y2 - e.y1) * ({px} - e.x1) = 0D"
        f" AND {px} BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)"
    )
    flips = walk_flips("e.", px, py, "p.border", "e.crosses", "e.above")
    # most edges end at the first test
    weight = (
        f"CASE WHEN NOT e.crosses AND ({py} < e.low OR {py} > e.high) THEN 0 WHEN {on_edge} THEN {_TOUCH} ELSE {flips} END"
    )
    total = f"aggregate(p.edges, p.parity, (n, e) -> n + {weight})"
    inside = f"CASE WHEN size(p.edges) = 0 THEN p.parity ELSE {total} END"
    found = f"transform(_c_{layer}, p -> named_struct('id', p.id, 'n', {inside}))"
    return F.expr(f"array_min(transform(filter({found}, f -> f.n >= {_TOUCH} OR f.n % 2 = 1), f -> f.id))")


def _closest(layer: str, px: str, py: str) -> Column:
    """Distance in millimetres and place in ``_c_<layer>`` of the nearest candidate, packed into one number.

    The candidates are in the order of their ids, so the smallest number is the nearest with the lowest id.
    """
    millimetres = f"floor({candidate_distance('c', px, py)} * 1000D + 0.5D)"
    return F.expr(f"array_min(transform(_c_{layer}, (c, i) -> {millimetres} * {1 << _PLACE_BITS}L + i))")


def within(
    points: DataFrame, indexes: Sequence[CellIndex], x: str, y: str, out: Mapping[str, str]
) -> DataFrame:
    """Add the id of the polygon that holds the point, per layer (``out``: layer -> column), or -1.

    The border counts as inside. Where polygons overlap the lowest id wins.
    """
    held = _held(indexes)
    located = _probe(points, indexes, list(out), x, y)
    found = {}
    for layer, column in out.items():
        lowest = _containing(layer, x, y) if layer in held else F.lit(None)
        found[column] = F.coalesce(lowest, F.lit(NO_ID).cast("bigint"))
    return located.select(*points.columns, *[c.alias(n) for n, c in found.items()])


def nearest(
    points: DataFrame, indexes: Sequence[CellIndex], x: str, y: str, out: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Add the nearest feature per layer (``out``: layer -> id column and distance column in km).

    ``x, y`` are projected metres. Distances are compared in whole millimetres and the lowest id wins a tie;
    the result is rounded to 2 decimals. Points that are null or NaN, and layers without features, give ``-1`` and ``-1.0``.
    """
    held = [layer for layer in out if layer in _held(indexes)]
    located = _probe(points, indexes, held, x, y)
    best = [_closest(layer, x, y).alias(f"_n_{layer}") for layer in held]
    located = located.select(*points.columns, *[f"_c_{layer}" for layer in held], *best)
    found = []
    for layer, (id_column, km_column) in out.items():
        number, km = F.lit(None).cast("bigint"), F.lit(None).cast("double")
        if layer in held:
            number = F.expr(f"get(_c_{layer}, CAST(_n_{layer} & {(1 << _PLACE_BITS) - 1}L AS INT)).id")
            km = F.floor((F.shiftright(f"_n_{layer}", _PLACE_BITS) + 5000) / 10000) / 100.0
        found.append(F.coalesce(number, F.lit(NO_ID).cast("bigint")).alias(id_column))
        found.append(F.coalesce(km, F.lit(NO_DISTANCE)).alias(km_column))
    return located.select(*points.columns, *found)
