"""Planar predicates and measures over edge columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.geometry import first_vertex
from emberline.functions.projections import mercator_lonlat, mercator_xy


def crosses_ray(x1: Column, y1: Column, x2: Column, y2: Column, px: Column, py: Column) -> Column:
    """True if the ray from the point to +x crosses the edge (half-open in y: a vertex counts once)."""
    straddles = (y1 > py) != (y2 > py)
    at_x = (x2 - x1) * (py - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1
    return straddles & (px < at_x)


def on_edge(x1: Column, y1: Column, x2: Column, y2: Column, px: Column, py: Column) -> Column:
    """True if the point lies exactly on the edge."""
    cross = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
    return (
        (cross == 0)
        & px.between(F.least(x1, x2), F.greatest(x1, x2))
        & py.between(F.least(y1, y2), F.greatest(y1, y2))
    )


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar distance from a point to a segment (or to a point, if the segment is degenerate)."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.coalesce(((px - x1) * dx + (py - y1) * dy) / F.nullif(length2, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - x1 - dx * t, py - y1 - dy * t
    return F.sqrt(ex * ex + ey * ey)


def centroid(parts: Column) -> Column:
    """``STRUCT<lat, lon>`` of a polygon's area centroid, measured in the Mercator plane, 6 decimals.

    Holes count negative whatever their orientation. Sums are taken relative to the first vertex, so that
    the large plane coordinates cost no precision. A geometry without area yields its first vertex.
    """
    anchor = first_vertex(parts)
    ox, oy = mercator_xy(anchor["x"], anchor["y"])

    def local(vertex: Column) -> Column:
        x, y = mercator_xy(vertex["x"], vertex["y"])
        return F.struct((x - ox).alias("x"), (y - oy).alias("y"))

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(total: Column, a: Column, mx: Column, my: Column) -> Column:
        return F.struct((total["a"] + a).alias("a"), (total["mx"] + mx).alias("mx"), (total["my"] + my).alias("my"))

    def ring_moments(ring: Column, is_hole: Column) -> Column:
        path = F.transform(ring, local)
        edges = F.zip_with(
            F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))),
            F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))),
            lambda p, q: F.struct(p.alias("p"), q.alias("q")),
        )

        def step(total: Column, e: Column) -> Column:
            p, q = e["p"], e["q"]
            cross = p["x"] * q["y"] - q["x"] * p["y"]
            return add(total, cross, (p["x"] + q["x"]) * cross, (p["y"] + q["y"]) * cross)

        def signed(total: Column) -> Column:
            sign = F.when(is_hole, -F.signum(total["a"])).otherwise(F.signum(total["a"]))
            return F.struct((total["a"] * sign).alias("a"), (total["mx"] * sign).alias("mx"), (total["my"] * sign).alias("my"))

        return F.aggregate(edges, zero, step, signed)

    rings = F.flatten(F.transform(parts, lambda polygon: F.transform(polygon, lambda r, i: ring_moments(r, i > 0))))

    def place(total: Column) -> Column:
        area3 = F.nullif(total["a"] * 3, F.lit(0.0))
        x = ox + F.coalesce(total["mx"] / area3, F.lit(0.0))
        y = oy + F.coalesce(total["my"] / area3, F.lit(0.0))
        lon, lat = mercator_lonlat(x, y)
        return F.struct(F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))

    return F.aggregate(rings, zero, lambda t, m: add(t, m["a"], m["mx"], m["my"]), place)
