"""Geometry functions and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.inputs import cleaned, context, spread
from emberline.functions.geometry import explode_segments, parts_from_wkt, wkt_from_parts, wkt_kind
from emberline.functions.measures import centroid
from emberline.functions.projections import polyconic_xy
from emberline.operators.spatial_joins import nearest, within
from emberline.plans.enrichment import enrich_hotspots
from fixtures import MERCATOR_Y, fixture, oracle

_SHAPES = """
SELECT 'terra' AS camada, codigo_ti AS id, geometria_wkt FROM lands
UNION ALL SELECT 'municipio', codigo_ibge, geometria_wkt FROM cities
UNION ALL SELECT 'linha', id_linha_transmissao, geometria_wkt FROM lines"""


def _shapes(spark, sf):
    wkt = F.col("geometria_wkt")
    return fixture(spark, sf, _SHAPES).select("camada", "id", wkt_kind(wkt).alias("tipo"), parts_from_wkt(wkt).alias("parts"))


@query("wkt_parse", oracle("""
SELECT 'terra' AS camada, CAST(id AS BIGINT) AS id, part, ring, x1, y1, x2, y2 FROM land_edges
UNION ALL SELECT 'municipio', id, part, ring, x1, y1, x2, y2 FROM city_edges
UNION ALL SELECT 'linha', id, 0, 0, x1, y1, x2, y2 FROM line_ends"""))
def _(spark, sf):
    return explode_segments(_shapes(spark, sf), "parts", "camada", "id")


def _n(expression: str) -> str:
    text = f"CAST(CAST(round({expression}, 6) AS DECIMAL(28, 6)) AS VARCHAR)"
    return rf"regexp_replace(regexp_replace({text}, '\.?0+$', ''), '^-0$', '0')"


def _v(x: str, y: str) -> str:
    return f"{_n(x)} || ' ' || {_n(y)}"


@query("wkt_format", oracle(f"""
SELECT 'terra' AS camada, CAST(codigo_ti AS BIGINT) AS id,
  'POLYGON ((' || {_v('x0', 'y0')} || ', ' || {_v('x0 + 7e0', 'y0 + 1e0')} || ', ' || {_v('x0 + 3e0', 'y0 + 7.5e0')}
  || ', ' || {_v('x0', 'y0')} || '), (' || {_v('x0 + 3e0', 'y0 + 2e0')} || ', ' || {_v('x0 + 4e0', 'y0 + 2e0')}
  || ', ' || {_v('x0 + 3.5e0', 'y0 + 4e0')} || ', ' || {_v('x0 + 3e0', 'y0 + 2e0')} || '))' AS wkt FROM land_corners
UNION ALL SELECT 'municipio', codigo_ibge,
  'MULTIPOLYGON (((' || {_v('x0', 'y0')} || ', ' || {_v('x0 + 2e0', 'y0 + 0.25e0')} || ', '
  || {_v('x0 + 1.5e0', 'y0 + 2e0')} || ', ' || {_v('x0', 'y0')} || ')), ((' || {_v('x0 + 2.5e0', 'y0')} || ', '
  || {_v('x0 + 3e0', 'y0')} || ', ' || {_v('x0 + 3e0', 'y0 + 0.5e0')} || ', ' || {_v('x0 + 2.5e0', 'y0')} || ')))'
  FROM city_corners
UNION ALL SELECT 'linha', id, 'LINESTRING (' || {_v('x1', 'y1')} || ', ' || {_v('x2', 'y2')} || ')' FROM line_ends"""))
def _(spark, sf):
    return _shapes(spark, sf).select("camada", "id", wkt_from_parts(F.col("tipo"), F.col("parts")).alias("wkt"))


_MERC = MERCATOR_Y.format
_CENTROID = f"""
WITH shapes AS (
  SELECT 'terra' AS camada, CAST(e.id AS BIGINT) AS id, part, ring, x1, y1, x2, y2, x0, y0
  FROM land_edges e JOIN land_corners c ON c.codigo_ti = e.id
  UNION ALL SELECT 'municipio', e.id, part, ring, x1, y1, x2, y2, x0, y0
  FROM city_edges e JOIN city_corners c ON c.codigo_ibge = e.id),
plane AS (SELECT camada, id, part, ring, radians(x0) AS ox, {_MERC(lat='y0')} AS oy,
  radians(x1) - radians(x0) AS ax, {_MERC(lat='y1')} - {_MERC(lat='y0')} AS ay,
  radians(x2) - radians(x0) AS bx, {_MERC(lat='y2')} - {_MERC(lat='y0')} AS dy FROM shapes),
rings AS (SELECT camada, id, part, ring, ox, oy, sum(ax * dy - bx * ay) AS a,
  sum((ax + bx) * (ax * dy - bx * ay)) AS mx, sum((ay + dy) * (ax * dy - bx * ay)) AS my
  FROM plane GROUP BY ALL),
whole AS (SELECT camada, id, ox, oy, sum(CASE WHEN ring = 0 THEN 1 ELSE -1 END * sign(a) * a) AS a,
  sum(CASE WHEN ring = 0 THEN 1 ELSE -1 END * sign(a) * mx) AS mx,
  sum(CASE WHEN ring = 0 THEN 1 ELSE -1 END * sign(a) * my) AS my FROM rings GROUP BY ALL)
SELECT camada, id, round(degrees(atan((exp(oy + my / (3 * a)) - exp(-(oy + my / (3 * a)))) / 2)), 6) AS lat_centroide,
  round(degrees(ox + mx / (3 * a)), 6) AS lon_centroide FROM whole"""


@query("centroid", oracle(_CENTROID))
def _(spark, sf):
    shapes = _shapes(spark, sf).filter(F.col("camada") != "linha")
    return shapes.select("camada", "id", centroid(F.col("parts")).alias("c")).select(
        "camada", "id", F.col("c.lat").alias("lat_centroide"), F.col("c.lon").alias("lon_centroide")
    )


def _points(spark, sf):
    x, y = polyconic_xy(F.col("longitude"), F.col("latitude"))
    known = ~F.isnan("longitude") & ~F.isnan("latitude")
    return cleaned(spark, sf).select(
        "event_id", *[F.when(known, c).alias(n) for c, n in
                      ((F.col("longitude"), "lon"), (F.col("latitude"), "lat"), (x, "x"), (y, "y"))]
    )


@query("project_polyconic", oracle("""
SELECT event_id, CASE WHEN NOT isnan(px) AND NOT isnan(py) THEN round(px) END AS x, CASE WHEN NOT isnan(px) AND NOT isnan(py) THEN round(py) END AS y
FROM points"""))
def _(spark, sf):
    return _points(spark, sf).select("event_id", F.round("x").alias("x"), F.round("y").alias("y"))


@query("pip_join", oracle("""
SELECT p.event_id, coalesce(codigo_ti, -1) AS codigo_ti, coalesce(codigo_ibge_espacial, -1) AS codigo_ibge_espacial
FROM points p LEFT JOIN in_lands USING (event_id) LEFT JOIN in_cities USING (event_id)"""))
def _(spark, sf):
    found = within(
        _points(spark, sf), context(spark, sf).areas, "lon", "lat",
        {"terras": "codigo_ti", "municipios": "codigo_ibge_espacial"},
    )
    return found.select("event_id", "codigo_ti", "codigo_ibge_espacial")


@query("nearest_line", oracle("""
SELECT p.event_id, coalesce(id_linha_transmissao, -1) AS id_linha_transmissao,
  coalesce(distancia_linha_km, -1e0) AS distancia_linha_km, coalesce(id_trecho_rodoviario, -1) AS id_trecho_rodoviario,
  coalesce(distancia_rodovia_km, -1e0) AS distancia_rodovia_km
FROM points p LEFT JOIN near_lines USING (event_id) LEFT JOIN near_roads USING (event_id)"""))
def _(spark, sf):
    found = nearest(_points(spark, sf), context(spark, sf).distances, "x", "y", {
        "linhas": ("id_linha_transmissao", "distancia_linha_km"),
        "rodovias": ("id_trecho_rodoviario", "distancia_rodovia_km"),
    })
    return found.select(
        "event_id", "id_linha_transmissao", "distancia_linha_km", "id_trecho_rodoviario", "distancia_rodovia_km"
    )


@query("nearest_point", oracle("""
SELECT p.event_id, coalesce(id_subestacao, -1) AS id_subestacao,
  coalesce(distancia_subestacao_km, -1e0) AS distancia_subestacao_km,
  coalesce(codigo_cnes_prox, -1) AS codigo_cnes_prox, coalesce(distancia_hospital_km, -1e0) AS distancia_hospital_km
FROM points p LEFT JOIN near_stations USING (event_id) LEFT JOIN near_hospitals USING (event_id)"""))
def _(spark, sf):
    found = nearest(_points(spark, sf), context(spark, sf).distances, "x", "y", {
        "subestacoes": ("id_subestacao", "distancia_subestacao_km"),
        "hospitais": ("codigo_cnes_prox", "distancia_hospital_km"),
    })
    return found.select(
        "event_id", "id_subestacao", "distancia_subestacao_km", "codigo_cnes_prox", "distancia_hospital_km"
    )


ENRICHED = """
SELECT event_id, id_data, data_hora, estado || '_' || municipio AS chave_localidade,
  coalesce(codigo_ti, -1) AS codigo_ti, coalesce(codigo_ibge_espacial, -1) AS codigo_ibge_espacial,
  coalesce(id_trecho_rodoviario, -1) AS id_trecho_rodoviario, coalesce(distancia_rodovia_km, -1e0) AS distancia_rodovia_km,
  coalesce(id_linha_transmissao, -1) AS id_linha_transmissao, coalesce(distancia_linha_km, -1e0) AS distancia_linha_km,
  coalesce(id_subestacao, -1) AS id_subestacao, coalesce(distancia_subestacao_km, -1e0) AS distancia_subestacao_km,
  coalesce(id_sistema_isolado, -1) AS id_sistema_isolado,
  coalesce(distancia_sistema_isolado_km, -1e0) AS distancia_sistema_isolado_km,
  coalesce(codigo_cnes_prox, -1) AS codigo_cnes_prox, coalesce(distancia_hospital_km, -1e0) AS distancia_hospital_km,
  latitude, longitude, bioma_inpe, satelite_sensor, dias_sem_chuva, precipitacao_mm, risco_fogo_inpe,
  potencia_radiativa_fogo
FROM clean LEFT JOIN in_lands USING (event_id) LEFT JOIN in_cities USING (event_id)
LEFT JOIN near_roads USING (event_id) LEFT JOIN near_lines USING (event_id) LEFT JOIN near_stations USING (event_id)
LEFT JOIN near_systems USING (event_id) LEFT JOIN near_hospitals USING (event_id)"""


@query("enrich_hotspots", oracle(ENRICHED))
def _(spark, sf):
    return enrich_hotspots(spread(spark, fixture(spark, sf, "hotspots")), context(spark, sf), "event_id")
