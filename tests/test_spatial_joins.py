import math
import random
import re
from functools import reduce
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from emberline.functions.projections import polyconic_xy
from emberline.operators import joins
from emberline.operators import spatial_index as SI
from emberline.operators.spatial_joins import nearest, within
from emberline.plans.enrichment import build_context, enrich_hotspots
from emberline.schemas import ENRICHED_HOTSPOT, RAW_HOTSPOT


def brute_nearest(points, segments):
    """Plain Python: (lowest id at the smallest whole-millimetre distance, km)."""
    out = []
    for px, py in points:
        best = None
        for i, x1, y1, x2, y2 in segments:
            dx, dy = x2 - x1, y2 - y1
            n = dx * dx + dy * dy
            t = max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / n)) if n else 0.0
            d = math.hypot(px - x1 - dx * t, py - y1 - dy * t)
            key = (math.floor(d * 1000 + 0.5), i)
            best = key if best is None else min(best, key)
        out.append((best[1], ((best[0] + 5000) // 10000) / 100))
    return out


def metric_frame(spark, segments, layer="a"):
    return spark.createDataFrame(
        [(layer, *s) for s in segments], "layer string, id bigint, x1 double, y1 double, x2 double, y2 double"
    )


def point_frame(spark, points):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "k int, x double, y double")


def probe(spark, segments, points, **options):
    frame = point_frame(spark, points)
    indexes = SI.nearest_index(metric_frame(spark, segments), **options)
    rows = nearest(frame, indexes, "x", "y", {"a": ("id", "km")}).orderBy("k").collect()
    return [(r["id"], r["km"]) for r in rows]


def random_case(seed, n_segments, n_points):
    rnd = random.Random(seed)
    # a third of the segments crowds into one corner
    def place():
        return (rnd.gauss(5.2e6, 3e3), rnd.gauss(9.1e6, 3e3)) if rnd.random() < 0.34 else (rnd.uniform(4e6, 6e6), rnd.uniform(8e6, 1e7))

    segments = []
    for i in range(n_segments):
        x, y = place()
        kind = rnd.random()
        dx, dy = (0.0, 0.0) if kind < 0.3 else (rnd.gauss(0, 4e4), rnd.gauss(0, 4e4))
        segments.append((i, x, y, x + dx, y + dy))
    points = [place() for _ in range(n_points)]
    points += [(-2e7 + 1, 9e6), (3e7, 2e7), (5e6, 1e7)]  # far away
    points += [(s[1], s[2]) for s in segments[:20]]  # on a vertex
    return segments, points


@pytest.mark.parametrize("seed, capacity", [(1, 4), (2, 24)])
def test_nearest_equals_brute_force(spark, seed, capacity):
    segments, points = random_case(seed, 300, 400)
    assert probe(spark, segments, points, capacity=capacity) == brute_nearest(points, segments)


def test_nearest_through_the_shuffled_path(spark, monkeypatch):
    segments, points = random_case(3, 200, 200)
    monkeypatch.setattr(SI, "BROADCAST_BYTES", 0)
    assert probe(spark, segments, points) == brute_nearest(points, segments)


@pytest.mark.parametrize("hot", [False, True])
def test_a_large_index_stays_in_its_buckets(spark, monkeypatch, hot):
    segments, points = random_case(6, 300, 300)
    points += [points[0]] * 600 + [(float("nan"), 9e6)] * 50  # two thirds in one leaf, and some in none
    monkeypatch.setattr(SI, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 0 if hot else 10_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        indexes = SI.nearest_index(metric_frame(spark, segments), capacity=8)
        assert [i.broadcastable for i in indexes] == [False] and indexes[0].buckets >= 8
        out = nearest(point_frame(spark, points), indexes, "x", "y", {"a": ("id", "km")})
        rows = out.orderBy("k").collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    assert [(r["id"], r["km"]) for r in rows] == brute_nearest(points[:-50], segments) + [(-1, -1.0)] * 50
    # only the points are shuffled; a hot leaf takes its place by broadcast
    joined = plan.split("Subqueries")[0]
    assert f"SelectedBucketsCount: {indexes[0].buckets}" in joined and joined.count("SortMergeJoin") == 1
    assert len(re.findall(r"Exchange hashpartitioning\(_key", joined)) == 1


def test_one_search_and_one_join_serve_all_layers(spark):
    segments, points = random_case(9, 200, 100)
    layers = {"a": segments, "b": [(i, *s[1:]) for i, s in enumerate(segments[150:])], "c": [(7, 5e6, 9e6, 5e6, 9e6)]}
    frame = reduce(lambda one, two: one.unionByName(two), [metric_frame(spark, rows, name) for name, rows in layers.items()])
    indexes = SI.nearest_index(frame, capacity=6)
    out = nearest(point_frame(spark, points), indexes, "x", "y", {n: (f"id_{n}", f"km_{n}") for n in layers})
    rows = out.orderBy("k").collect()
    for name, own in layers.items():
        assert [(r[f"id_{name}"], r[f"km_{name}"]) for r in rows] == brute_nearest(points, own)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(indexes) == 1 and plan.count("BroadcastHashJoin") in (1, 2) and "SortMergeJoin" not in plan  # 2: the final and the first plan


def test_places_beyond_the_box_need_only_the_sides_they_see(spark):
    rnd = random.Random(11)
    segments = [(i, x := rnd.uniform(4e6, 6e6), y := rnd.uniform(8e6, 1e7), x, y) for i in range(400)]
    index, = SI.nearest_index(metric_frame(spark, segments))
    widths = {r["place"]: r["n"] for r in index.leaves.select("place", F.size("a").alias("n")).filter("place < 0").collect()}
    assert sorted(widths) == [-9, -8, -7, -6, -4, -3, -2, -1]
    assert all(max(widths[-2], widths[-4]) <= n for n in [widths[-1]]) and sum(widths[s] for s in (-2, -4, -6, -8)) < 2 * max(widths.values()) + 100


def test_nearest_ties_and_copies(spark):
    # copies of one feature, and two features that share a vertex: the lowest id wins
    segments = [(9, 5e6, 9e6, 5e6, 9e6)] + [(i, 5.1e6, 9e6, 5.1e6, 9e6) for i in range(40, 10, -1)]
    segments += [(8, 5.2e6, 9e6, 5.3e6, 9e6), (7, 5.3e6, 9e6, 5.2e6, 9e6), (6, 5.2e6, 9e6, 5.2e6, 9.1e6)]
    points = [(5e6, 9e6), (5.1e6, 9e6 + 1), (5.19e6, 8.99e6), (5.25e6, 9e6)]
    assert probe(spark, segments, points, capacity=2) == brute_nearest(points, segments) == [
        (9, 0.0), (11, 0.0), (6, 14.14), (7, 0.0)
    ]


def test_nearest_far_from_all_features_is_exact(spark):
    rnd = random.Random(8)
    segments, _ = random_case(4, 150, 1)
    points = [(rnd.uniform(-2e7, 3e7), rnd.uniform(-2e7, 4e7)) for _ in range(300)] + [(5e6, 1e7), (6e7, -5e7), (4e6 - 4e5, 9e6)]
    assert probe(spark, segments, points) == brute_nearest(points, segments)
    assert probe(spark, [(1, 5e6, 9e6, 5e6, 9e6)], [(2e7, 9e6), (float("nan"), 9e6)]) == [(1, 15000.0), (-1, -1.0)]


def test_segments_that_meet_in_one_vertex_stay_small(spark):
    spokes = [(i, 5e6, 9e6, 5e6 + 1e5 * math.cos(i * math.pi / 150), 9e6 + 1e5 * math.sin(i * math.pi / 150)) for i in range(300)]
    indexes = SI.nearest_index(metric_frame(spark, spokes))
    assert sum(i.n_entries for i in indexes) < 50_000
    points = [(5e6 + r * math.cos(a), 9e6 + r * math.sin(a)) for r in (0, 1, 50, 3e3, 9e4, 4e5) for a in (0.1, 1.7, 4.0)]
    rows = nearest(point_frame(spark, points), indexes, "x", "y", {"a": ("id", "km")}).orderBy("k").collect()
    assert [(r["id"], r["km"]) for r in rows] == brute_nearest(points, spokes)


def test_nested_polygons_stay_small(spark):
    def square(i):
        r = 1.0 + i / 1000
        return (i, f"POLYGON (({-50 - r} {-10 - r}, {-50 + r} {-10 - r}, {-50 + r} {-10 + r}, {-50 - r} {-10 + r}, {-50 - r} {-10 - r}))")

    frame = spark.createDataFrame([square(i) for i in range(1000)], "id bigint, geometria_wkt string")
    indexes = SI.containment_index(SI.polygon_edges(SI.layer_shapes({"a": (frame, "id")})), levels=(9, 11, 13))
    widest = max(i.leaves.agg(F.max(F.size("a"))).first()[0] for i in indexes)
    assert widest <= 200
    points = [(-50.0, -10.0), (-48.9995, -10.0), (-48.5005, -10.0), (-47.9, -10.0), (-48.0, -9.0)]
    rows = within(point_frame(spark, points), indexes, "x", "y", {"a": "id"}).orderBy("k").collect()
    assert [r["id"] for r in rows] == [0, 1, 500, -1, -1]


def brute_within(points, polygons):
    out = []
    for px, py in points:
        hit = []
        for i, rings in polygons:
            inside = False
            for ring in rings:
                for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                    if (x2 - x1) * (py - y1) == (y2 - y1) * (px - x1) and min(x1, x2) <= px <= max(x1, x2) and min(
                        y1, y2
                    ) <= py <= max(y1, y2):
                        hit.append(i)
                    if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                        inside = not inside
            if inside:
                hit.append(i)
        out.append(min(hit, default=-1))
    return out


def star(rnd, cx, cy, r, n):
    ring = []
    for k in range(n):
        reach = r * rnd.uniform(0.4, 1)
        ring.append((cx + reach * math.cos(2 * math.pi * k / n), cy + reach * math.sin(2 * math.pi * k / n)))
    return [*ring, ring[0]]


def test_within_equals_brute_force(spark):
    rnd = random.Random(5)
    polygons = []
    for i in range(25):
        cx, cy, r = rnd.uniform(-70, -40), rnd.uniform(-30, 0), rnd.choice([0.05, 0.5, 4.0])
        polygons.append((i, [star(rnd, cx, cy, r, rnd.choice([5, 40, 90])), star(rnd, cx, cy, r / 4, 6)]))
    # integer squares with a hole: points on borders and corners
    polygons.append((90, [[(-60, -10), (-50, -10), (-50, 0), (-60, 0), (-60, -10)], [(-57, -7), (-53, -7), (-53, -3), (-57, -3), (-57, -7)]]))
    points = [(rnd.uniform(-72, -38), rnd.uniform(-32, 2)) for _ in range(600)]
    points += [q[1][0][0] for q in polygons]  # vertices
    # around the small polygons, and a copy of one of them
    points += [(q[1][0][0][0] + rnd.gauss(0, 0.05), q[1][0][0][1] + rnd.gauss(0, 0.05)) for q in polygons for _ in range(10)]
    polygons.append((-5, polygons[3][1]))
    points += [(-60.0, -5.0), (-50.0, 0.0), (-55.0, -5.0), (-57.0, -5.0), (-55.0, -3.0), (-58.0, -5.0), (-61.0, -10.0), (179.0, 85.0)]
    wkt = [
        (i, "POLYGON (" + ", ".join("(" + ", ".join(f"{float(x)!r} {float(y)!r}" for x, y in ring) + ")" for ring in rings) + ")")
        for i, rings in polygons
    ]
    frame = spark.createDataFrame(wkt, "id bigint, geometria_wkt string")
    edges = SI.polygon_edges(SI.layer_shapes({"a": (frame, "id")}))
    for capacity in (16, 1000):
        indexes = SI.containment_index(edges, capacity=capacity)
        rows = within(point_frame(spark, points), indexes, "x", "y", {"a": "id"}).orderBy("k").collect()
        assert [r["id"] for r in rows] == brute_within(points, polygons)


def raw_hotspot(spark, rows):
    full = [("2024-01-01 10:00:00", "Pará", "Belém", lat, lon, "Amazônia", "AQUA", 1.0, 0.0, 0.5, 10.0) for lat, lon in rows]
    return spark.createDataFrame(full, RAW_HOTSPOT)


def test_enrichment_without_layers_and_with_bad_positions(spark):
    raw = raw_hotspot(spark, [(-1.0, -48.0), (float("nan"), -48.0), (None, None)])
    context = build_context({})
    out = enrich_hotspots(raw, context)
    assert out.columns == ENRICHED_HOTSPOT.fieldNames()
    for row in out.collect():
        assert row["codigo_ti"] == -1 and row["distancia_linha_km"] == -1.0 and row["codigo_cnes_prox"] == -1


def test_enrichment_of_absent_and_nan_positions(spark):
    points = spark.createDataFrame([(7, -48.0, -1.0)], "codigo_cnes bigint, longitude double, latitude double")
    empty = points.filter("false").withColumnRenamed("codigo_cnes", "id_subestacao")
    raw = raw_hotspot(spark, [(-1.0, -48.0), (float("nan"), -48.0), (None, None)])
    context = build_context({"hospitais": points, "subestacoes": empty})
    rows = enrich_hotspots(raw, context).collect()
    got = {str(r["latitude"]): (r["codigo_cnes_prox"], r["distancia_hospital_km"], r["id_subestacao"]) for r in rows}
    assert got["-1.0"] == (7, 0.0, -1)
    assert got["nan"] == (-1, -1.0, -1)
    # a missing column counts as 0.0
    far = enrich_hotspots(raw.drop("Latitude", "Longitude").limit(1), context).first()
    df = spark.sql("SELECT 0D lon, 0D lat UNION ALL SELECT -48D, -1D")
    (x0, y0), (x1, y1) = [tuple(r) for r in df.select(*polyconic_xy(F.col("lon"), F.col("lat"))).collect()]
    assert far["distancia_hospital_km"] == pytest.approx(math.hypot(x0 - x1, y0 - y1) / 1000, abs=0.006)


def test_a_long_slanting_edge_is_kept_only_where_it_passes(spark):
    # 32 x 32 cells in the box of each edge; a diagonal passes through its cells and touches the corners of those beside it
    size, cells = 0.25, spark.range(32).withColumnRenamed("id", "ix").crossJoin(spark.range(32).withColumnRenamed("id", "iy"))
    edges = spark.createDataFrame([(0.0, 0.0, 8.0, 8.0), (0.0, 8.0, 8.0, 0.0), (8.0, 7.0, 0.0, 1.0)], "x1 double, y1 double, x2 double, y2 double")
    kept = SI._touching(edges.crossJoin(cells), F.col("ix") * size, F.col("iy") * size, size)
    found = {(r["x1"], r["y1"]): r["n"] for r in kept.groupBy("x1", "y1").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found[(0.0, 0.0)] == found[(0.0, 8.0)] == 32 + 2 * 31
    # 32 columns, and 24 rows crossed on the way; every second or so of these at a corner of cells
    assert 32 + 24 - 1 <= found[(8.0, 7.0)] <= 32 + 24 - 1 + 2 * 9


def test_polygons_that_overlap_on_long_edges_have_a_small_index(spark):
    rnd = random.Random(11)
    corners = [(rnd.uniform(-60, -58), rnd.uniform(-20, -18)) for _ in range(40)]
    shapes = [(i, f"POLYGON (({x} {y}, {x + 6} {y + 0.7}, {x + 4.1} {y + 6}, {x} {y}))") for i, (x, y) in enumerate(corners)]
    lands = spark.createDataFrame(shapes, "codigo_ti bigint, geometria_wkt string")
    (index,) = build_context({"terras": lands}).areas
    assert index.n_entries < 20_000
    points = [(rnd.uniform(-61, -51), rnd.uniform(-21, -11)) for _ in range(400)]

    def inside(px, py, x, y):
        ring = [(x, y), (x + 6, y + 0.7), (x + 4.1, y + 6), (x, y)]
        meets = [(b > py) != (d > py) and px < (c - a) * (py - b) / (d - b) + a for (a, b), (c, d) in zip(ring, ring[1:])]
        return sum(meets) % 2 == 1

    rows = within(point_frame(spark, points), [index], "x", "y", {"terras": "id"}).orderBy("k").collect()
    assert [r["id"] for r in rows] == [min((i for i, c in enumerate(corners) if inside(*p, *c)), default=-1) for p in points]


def test_layers_of_other_density_do_not_copy_their_arrays(spark, monkeypatch):
    # few long lines beside many points: cut at the borders of the points' leaves, the lines' arrays would be copied for each
    monkeypatch.setattr(SI, "SHARED_BYTES", 0)
    rnd = random.Random(5)
    place = lambda: (rnd.uniform(5e6, 5.2e6), rnd.uniform(9e6, 9.2e6))
    points = [(i, *p, *p) for i, p in enumerate(place() for _ in range(1500))]
    lines = [(i, x, y, x + 3e4, y + 2e4) for i, (x, y) in enumerate(place() for _ in range(40))]
    before = set(_scratch(spark))
    indexes = SI.nearest_index(metric_frame(spark, points, "p").unionByName(metric_frame(spark, lines, "l")))
    assert sorted(i.layers for i in indexes) == [("l",), ("p",)]
    assert sum(i.n_entries for i in indexes) < 40 * len(points)
    # only the indexes stay in the shared folder
    assert len(set(_scratch(spark)) - before) == len(indexes)
    wanted = [place() for _ in range(60)]
    rows = nearest(point_frame(spark, wanted), indexes, "x", "y", {"p": ("a", "a_km"), "l": ("b", "b_km")}).orderBy("k").collect()
    assert [(r["a"], r["a_km"]) for r in rows] == brute_nearest(wanted, points)
    assert [(r["b"], r["b_km"]) for r in rows] == brute_nearest(wanted, lines)


def _scratch(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir")) / "emberline" / spark.sparkContext.applicationId
    return [p.name for p in root.glob("*")]


def test_join_keys_do_not_carry_the_search(spark):
    # Catalyst would follow the key down to the table and write out the whole search
    indexes = SI.nearest_index(metric_frame(spark, [(1, 5.1e6, 9.1e6, 5.2e6, 9.2e6)]))
    plan = indexes[0].locate(point_frame(spark, [(5e6, 9e6)]), "x", "y", "place")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate explode\(array\(.*\[place#", plan)
