import math

import pytest
from pyspark.sql import functions as F

from emberline.functions.geometry import geojson_from_parts, parts_from_wkt, wkt_from_parts, wkt_kind
from emberline.functions.measures import centroid, on_edge, segment_distance
from emberline.functions.projections import mercator_lonlat, mercator_xy, polyconic_xy

ROUND_TRIP = [
    "POINT (1 2)",
    "LINESTRING (0 0, 1.5 -0.2, 3 3)",
    "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))",
    "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.1 5.1, 5.2 5.1, 5.2 5.2, 5.1 5.1)))",
    "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))",
    "MULTIPOINT ((1 1), (2 2))",
    "MULTIPOINT ((1 1))",
]


def test_wkt_round_trip(column):
    assert column(lambda c: wkt_from_parts(wkt_kind(c), parts_from_wkt(c)), ROUND_TRIP) == ROUND_TRIP


def test_wkt_odd_input(column):
    values = ["POLYGON EMPTY", None, "", "garbage", "point(1 2)", "MULTIPOINT (1 1, 2 2)", "POINT Z (1 2 3)"]
    got = column(lambda c: wkt_from_parts(wkt_kind(c), parts_from_wkt(c)), values)
    assert got == [None, None, None, None, "POINT (1 2)", "MULTIPOINT ((1 1), (2 2))", "POINT (1 2)"]


def test_geojson(column):
    got = column(lambda c: geojson_from_parts(wkt_kind(c), parts_from_wkt(c)), ["POINT (1 2)", "LINESTRING (0 0, 1 1)"])
    assert got == [
        '{"type":"Point","coordinates":[1.0,2.0]}',
        '{"type":"LineString","coordinates":[[0.0,0.0],[1.0,1.0]]}',
    ]


def xy(spark, lon, lat):
    df = spark.sql(f"SELECT CAST({lon} AS DOUBLE) lon, CAST({lat} AS DOUBLE) lat")
    x, y = polyconic_xy(F.col("lon"), F.col("lat"))
    return tuple(df.select(x, y).first())


def test_polyconic_origin_and_equator(spark):
    assert xy(spark, -54, 0) == (5_000_000.0, 10_000_000.0)
    x, y = xy(spark, -53, 0)
    assert x == pytest.approx(5_000_000 + 6378137 * math.radians(1)) and y == 10_000_000


def test_polyconic_is_true_along_the_central_meridian(spark):
    # meridian arc of one degree at 15 S on the GRS 1980 ellipsoid, by the radius of curvature
    e2 = 0.00669438002290
    radius = 6378137 * (1 - e2) / (1 - e2 * math.sin(math.radians(15)) ** 2) ** 1.5
    (_, a), (_, b) = xy(spark, -54, -14.5), xy(spark, -54, -15.5)
    assert a - b == pytest.approx(radius * math.radians(1), rel=1e-6)


def test_polyconic_close_to_great_circle_near_the_meridian(spark):
    (x1, y1), (x2, y2) = xy(spark, -54.5, -10), xy(spark, -53.5, -10.5)
    a, b = math.radians(10), math.radians(10.5)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(0.5)) ** 2
    sphere = 2 * 6371000 * math.asin(math.sqrt(h))
    assert math.hypot(x1 - x2, y1 - y2) == pytest.approx(sphere, rel=5e-3)


def test_mercator_inverse(spark):
    df = spark.sql("SELECT -47.9D lon, -15.8D lat")
    x, y = mercator_xy(F.col("lon"), F.col("lat"))
    lon, lat = mercator_lonlat(F.col("x"), F.col("y"))
    row = df.select(x.alias("x"), y.alias("y")).select(lon, lat).first()
    assert tuple(row) == pytest.approx((-47.9, -15.8), abs=1e-12)


def test_centroid(column):
    square = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"
    # a hole in the right half moves the centre to the left, whatever its orientation
    hole = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0), (1 0.5, 1 1.5, 2 1.5, 2 0.5, 1 0.5))"
    turned = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0), (1 0.5, 2 0.5, 2 1.5, 1 1.5, 1 0.5))"
    line = "POLYGON ((3 4, 3 4, 3 4))"
    got = column(lambda c: centroid(parts_from_wkt(c)), [square, hole, turned, line, None])
    assert got[0]["lon"] == 1.0 and got[0]["lat"] == pytest.approx(1.0, abs=1e-3)
    assert got[1] == got[2] and got[1]["lon"] == pytest.approx((4 * 1 - 1 * 1.5) / 3, abs=1e-3)
    assert (got[3]["lon"], got[3]["lat"]) == (3.0, 4.0)
    assert got[4] is None or got[4]["lon"] is None


def test_distance_and_edge(spark):
    df = spark.sql("SELECT 0D px, 3D py, -1D x1, 0D y1, 1D x2, 0D y2 UNION ALL SELECT 5D, 0D, 2D, 0D, 2D, 0D UNION ALL SELECT 0D, 0D, -1D, 0D, 1D, 0D")
    cols = [F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2")]
    rows = df.select(segment_distance(*cols).alias("d"), on_edge(*cols[2:], *cols[:2]).alias("on")).collect()
    assert [(r.d, r.on) for r in rows] == [(3.0, False), (3.0, False), (0.0, True)]
