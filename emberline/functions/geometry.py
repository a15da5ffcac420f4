"""Geometry columns: WKT and GeoJSON text to nested coordinates and back.

One shape serves all geometry types: ``parts ARRAY<ARRAY<ARRAY<STRUCT<x,y>>>>``, that is polygons, rings
(or paths) and vertices. Lines have one part with a path each, a point is a path with one vertex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS_TYPE = "array<array<array<struct<x:double,y:double>>>>"

_COORDINATE = r"([-+0-9.eE]+)\s+([-+0-9.eE]+)(?:\s+[-+0-9.eE]+)*"


def _vertices(json: Column) -> Column:
    """``parts`` from JSON text of nesting depth 4."""
    vertex = lambda v: F.struct(F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y"))
    nested = F.from_json(json, "array<array<array<array<double>>>>")
    return F.transform(nested, lambda part: F.transform(part, lambda path: F.transform(path, vertex)))


def _wrapped(kind: Column, json: Column) -> Column:
    """Bring the coordinates of every geometry type to depth 4 by adding outer brackets."""
    depth = F.when(kind.isin("POINT", "LINESTRING", "MULTIPOINT"), 2).when(
        kind.isin("POLYGON", "MULTILINESTRING"), 1
    ).when(kind == "MULTIPOLYGON", 0)
    return F.concat(F.repeat(F.lit("["), depth), json, F.repeat(F.lit("]"), depth))


def wkt_kind(wkt: Column) -> Column:
    return F.upper(F.regexp_extract(wkt, r"^\s*(?:SRID=\d+;)?\s*([A-Za-z]+)", 1))


def parts_from_wkt(wkt: Column) -> Column:
    """Coordinates of a WKT text; null for null, empty or unsupported geometries."""
    kind = wkt_kind(wkt)
    points = kind == "MULTIPOINT"
    body = F.nullif(F.regexp_extract(wkt, r"(?s)(\(.*\))", 1), F.lit(""))
    # the members of a MULTIPOINT may or may not stand in parentheses: drop them all, wrap each vertex
    vertex = F.when(points, "[[$1,$2]]").otherwise("[$1,$2]")
    brackets = F.when(points, "").otherwise("[]")
    json = F.call_function("translate", F.regexp_replace(body, F.lit(_COORDINATE), vertex), F.lit("()"), brackets)
    return _vertices(_wrapped(kind, json))


def parts_from_geojson(kind: Column, coordinates: Column) -> Column:
    """Coordinates of a GeoJSON geometry given its type and the raw JSON text of ``coordinates``."""
    kind = F.upper(kind)
    inner = F.substring(coordinates, F.lit(2), F.length(coordinates) - 2)
    json = (
        F.when(kind == "POINT", F.concat(F.lit("["), coordinates, F.lit("]")))
        .when(kind == "MULTIPOINT", F.regexp_replace(inner, r"(\[[^\[\]]*\])", "[$1]"))
        .otherwise(coordinates)
    )
    return _vertices(_wrapped(kind, json))


def number_text(c: Column, decimals: int | None) -> Column:
    """Plain decimal text without trailing zeros; ``decimals=None`` keeps the shortest exact text."""
    if decimals is None:
        return F.regexp_replace(c.cast("string"), r"\.0$", "")
    fixed = F.round(c, decimals).cast(f"decimal(28,{decimals})").cast("string")
    return F.regexp_replace(F.regexp_replace(fixed, r"\.?0+$", ""), r"^-0$", "0")


def wkt_from_parts(kind: Column, parts: Column, decimals: int | None = 6) -> Column:
    """WKT text of ``parts``; ``kind`` is the geometry type in any case."""
    kind = F.upper(kind)
    vertex = lambda v: F.concat_ws(" ", number_text(v["x"], decimals), number_text(v["y"], decimals))
    path = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, vertex), ", "), F.lit(")"))
    polygon = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, path), ", "), F.lit(")"))
    first_path = path(F.get(F.get(parts, F.lit(0)), F.lit(0)))
    paths = F.concat(F.lit("("), F.array_join(F.transform(F.flatten(parts), path), ", "), F.lit(")"))
    polygons = F.concat(F.lit("("), F.array_join(F.transform(parts, polygon), ", "), F.lit(")"))
    body = (
        F.when(kind.isin("POINT", "LINESTRING"), first_path)
        .when(kind.isin("POLYGON", "MULTILINESTRING", "MULTIPOINT"), paths)
        .otherwise(polygons)
    )
    return F.when(parts.isNotNull(), F.concat(kind, F.lit(" "), body))


def geojson_from_parts(kind: Column, parts: Column) -> Column:
    """GeoJSON geometry object as text."""
    upper = F.upper(kind)
    pair = lambda v: F.array(v["x"], v["y"])
    path = lambda r: F.transform(r, pair)
    polygon = lambda p: F.transform(p, path)
    first = F.get(parts, F.lit(0))
    names = {
        "POINT": ("Point", F.to_json(pair(F.get(F.get(first, F.lit(0)), F.lit(0))))),
        "LINESTRING": ("LineString", F.to_json(path(F.get(first, F.lit(0))))),
        "POLYGON": ("Polygon", F.to_json(polygon(first))),
        "MULTIPOINT": ("MultiPoint", F.to_json(path(F.flatten(F.flatten(parts))))),
        "MULTILINESTRING": ("MultiLineString", F.to_json(polygon(F.flatten(parts)))),
        "MULTIPOLYGON": ("MultiPolygon", F.to_json(F.transform(parts, polygon))),
    }
    out = None
    for key, (name, text) in names.items():
        value = F.concat(F.lit(f'{{"type":"{name}","coordinates":'), text, F.lit("}"))
        out = F.when(upper == key, value) if out is None else out.when(upper == key, value)
    return F.when(parts.isNotNull(), out)


def point_parts(lon: Column, lat: Column) -> Column:
    """A point geometry; null if a coordinate is missing."""
    vertex = F.struct(lon.cast("double").alias("x"), lat.cast("double").alias("y"))
    known = lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon.cast("double")) & ~F.isnan(lat.cast("double"))
    return F.when(known, F.array(F.array(F.array(vertex))))


def first_vertex(parts: Column) -> Column:
    return F.get(F.get(F.get(parts, F.lit(0)), F.lit(0)), F.lit(0))


def explode_segments(df: DataFrame, parts: str, *keep: str) -> DataFrame:
    """One row per ring or path segment: ``keep``, ``part``, ``ring``, ``x1, y1, x2, y2``.

    A path with a single vertex gives one degenerate segment.
    """
    rings = df.select(*keep, F.posexplode(parts).alias("part", "_rings"))
    paths = rings.select(*keep, "part", F.posexplode("_rings").alias("ring", "_path"))
    last = F.greatest(F.size("_path") - 2, F.lit(0))
    at = F.explode(F.sequence(F.lit(0), last)).alias("_i")
    ends = paths.filter(F.size("_path") > 0).select(*keep, "part", "ring", "_path", at).select(
        *keep,
        "part",
        "ring",
        F.get("_path", F.col("_i")).alias("_a"),
        F.get("_path", F.least(F.col("_i") + 1, F.size("_path") - 1)).alias("_b"),
    )
    return ends.select(
        *keep,
        "part",
        "ring",
        F.col("_a.x").alias("x1"),
        F.col("_a.y").alias("y1"),
        F.col("_b.x").alias("x2"),
        F.col("_b.y").alias("y2"),
    )
