"""Inputs for the registered queries, derived from the test tables.

Every fixture is one SQL text that Spark and DuckDB both run, so that the two engines start from the same rows.
Fractional literals are written with an exponent: Spark reads ``1000.0`` as DECIMAL, DuckDB as DOUBLE.

``FIXTURES`` holds texts both engines run. ``ORACLE`` adds texts for DuckDB only: the same results as the
library's operators, by brute force.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

ALTO_KM, MEDIO_KM = 200.0, 500.0

FIXTURES: dict[str, str] = {
    # raw hotspots with every kind of dirt
    "hotspots": """
SELECT event_id,
  CASE WHEN event_id % 113 = 0 THEN 'sem data' WHEN event_id % 127 = 0 THEN NULL
       WHEN event_id % 131 = 0 AND day > '12' THEN day || '/' || substr(CAST(ts AS STRING), 6, 2) || '/'
         || substr(CAST(ts AS STRING), 1, 4) || ' ' || moment
       ELSE substr(CAST(ts AS STRING), 1, 10) || ' ' || moment END AS DataHora,
  CASE WHEN event_id % 89 = 0 THEN NULL ELSE 'Estado ' || CAST(place % 3 AS STRING) END AS Estado,
  CASE WHEN event_id % 83 = 0 THEN '   ' WHEN event_id % 79 = 0 THEN ' São' || chr(10) || 'João, "' || CAST(place AS STRING) || '"'
       ELSE ' São João ' || CAST(place AS STRING) END AS Municipio,
  CASE WHEN event_id % 103 = 0 THEN NULL WHEN event_id % 107 = 0 THEN CAST('NaN' AS DOUBLE)
       WHEN event_id % 10 <> 0 THEN -30e0 + place * 7e0 + (event_id % 7) / 1e3
       WHEN event_id % 250 = 0 THEN -70e0 + ((event_id * 7919) % 130000) / 1e3
       ELSE -33.75e0 + ((event_id * 7919) % 39000) / 1e3 END AS Latitude,
  CASE WHEN event_id % 103 = 0 THEN NULL WHEN event_id % 109 = 0 THEN CAST('NaN' AS DOUBLE)
       WHEN event_id % 10 <> 0 THEN -70e0 + place * 6e0 + (event_id % 11) / 1e3
       WHEN event_id % 250 = 0 THEN -170e0 + ((event_id * 104729) % 330000) / 1e3
       ELSE -73.99e0 + ((event_id * 104729) % 39000) / 1e3 END AS Longitude,
  CASE place % 6 WHEN 0 THEN 'Amazônia' WHEN 1 THEN 'Cerrado' WHEN 2 THEN 'Caatinga'
       WHEN 3 THEN 'Mata Atlântica' WHEN 4 THEN 'Pampa' ELSE 'Pantanal' END AS Bioma,
  CASE WHEN event_type IN ('click', 'view') THEN 'AQUA' ELSE 'TERRA' END AS Satelite,
  CAST(event_id % 120 AS DOUBLE) AS DiaSemChuva,
  value / 1e1 AS Precipitacao,
  (event_id % 100) / 1e2 AS RiscoFogo,
  CASE WHEN event_id % 97 = 0 THEN -999e0 WHEN event_id % 101 = 0 THEN NULL ELSE value END AS FRP
FROM moments""",
    # few places and minutes, so that several hotspots share a row of the fact
    "moments": """
SELECT *, user_id % 5 AS place, substr(CAST(ts AS STRING), 9, 2) AS day,
  lpad(CAST((event_id % 4) * 5 AS STRING), 2, '0') || ':0' || CAST(event_id % 2 AS STRING) || ':'
  || lpad(CAST(CAST(floor(event_id / 4e0) AS BIGINT) % 60 AS STRING), 2, '0') AS moment
FROM events""",
    # indigenous lands: triangle with a triangular hole
    "land_corners": """
SELECT n_nationkey + 1 AS codigo_ti, 'Terra ' || n_name AS nome,
  -74e0 + (n_nationkey % 5) * 8e0 AS x0, -34e0 + floor(n_nationkey / 5e0) * 8e0 AS y0
FROM nation""",
    "lands": """
SELECT CAST(codigo_ti AS BIGINT) AS codigo_ti, nome AS nome_terra_indigena,
  'POLYGON ((' || CAST(x0 AS STRING) || ' ' || CAST(y0 AS STRING) || ', '
  || CAST(x0 + 7e0 AS STRING) || ' ' || CAST(y0 + 1e0 AS STRING) || ', '
  || CAST(x0 + 3e0 AS STRING) || ' ' || CAST(y0 + 7.5e0 AS STRING) || ', '
  || CAST(x0 AS STRING) || ' ' || CAST(y0 AS STRING) || '), ('
  || CAST(x0 + 3e0 AS STRING) || ' ' || CAST(y0 + 2e0 AS STRING) || ', '
  || CAST(x0 + 4e0 AS STRING) || ' ' || CAST(y0 + 2e0 AS STRING) || ', '
  || CAST(x0 + 3.5e0 AS STRING) || ' ' || CAST(y0 + 4e0 AS STRING) || ', '
  || CAST(x0 + 3e0 AS STRING) || ' ' || CAST(y0 + 2e0 AS STRING) || '))' AS geometria_wkt
FROM land_corners""",
    "land_edges": """
SELECT codigo_ti AS id, 0 AS part, 0 AS ring, x0 AS x1, y0 AS y1, x0 + 7e0 AS x2, y0 + 1e0 AS y2 FROM land_corners
UNION ALL SELECT codigo_ti, 0, 0, x0 + 7e0, y0 + 1e0, x0 + 3e0, y0 + 7.5e0 FROM land_corners
UNION ALL SELECT codigo_ti, 0, 0, x0 + 3e0, y0 + 7.5e0, x0, y0 FROM land_corners
UNION ALL SELECT codigo_ti, 0, 1, x0 + 3e0, y0 + 2e0, x0 + 4e0, y0 + 2e0 FROM land_corners
UNION ALL SELECT codigo_ti, 0, 1, x0 + 4e0, y0 + 2e0, x0 + 3.5e0, y0 + 4e0 FROM land_corners
UNION ALL SELECT codigo_ti, 0, 1, x0 + 3.5e0, y0 + 4e0, x0 + 3e0, y0 + 2e0 FROM land_corners""",
    # municipalities: two-part polygons that overlap each other
    "city_corners": """
SELECT 1100000 + s_suppkey AS codigo_ibge, ' Cidade  ção ' || CAST(s_suppkey AS STRING) AS nome,
  -72e0 + ((s_suppkey * 15485) % 35000) / 1e3 AS x0, -32e0 + ((s_suppkey * 32452) % 35000) / 1e3 AS y0
FROM supplier""",
    "cities": """
SELECT codigo_ibge, nome,
  'MULTIPOLYGON (((' || CAST(x0 AS STRING) || ' ' || CAST(y0 AS STRING) || ', '
  || CAST(x0 + 2e0 AS STRING) || ' ' || CAST(y0 + 0.25e0 AS STRING) || ', '
  || CAST(x0 + 1.5e0 AS STRING) || ' ' || CAST(y0 + 2e0 AS STRING) || ', '
  || CAST(x0 AS STRING) || ' ' || CAST(y0 AS STRING) || ')), (('
  || CAST(x0 + 2.5e0 AS STRING) || ' ' || CAST(y0 AS STRING) || ', '
  || CAST(x0 + 3e0 AS STRING) || ' ' || CAST(y0 AS STRING) || ', '
  || CAST(x0 + 3e0 AS STRING) || ' ' || CAST(y0 + 0.5e0 AS STRING) || ', '
  || CAST(x0 + 2.5e0 AS STRING) || ' ' || CAST(y0 AS STRING) || ')))' AS geometria_wkt
FROM city_corners""",
    "city_edges": """
SELECT codigo_ibge AS id, 0 AS part, 0 AS ring, x0 AS x1, y0 AS y1, x0 + 2e0 AS x2, y0 + 0.25e0 AS y2 FROM city_corners
UNION ALL SELECT codigo_ibge, 0, 0, x0 + 2e0, y0 + 0.25e0, x0 + 1.5e0, y0 + 2e0 FROM city_corners
UNION ALL SELECT codigo_ibge, 0, 0, x0 + 1.5e0, y0 + 2e0, x0, y0 FROM city_corners
UNION ALL SELECT codigo_ibge, 1, 0, x0 + 2.5e0, y0, x0 + 3e0, y0 FROM city_corners
UNION ALL SELECT codigo_ibge, 1, 0, x0 + 3e0, y0, x0 + 3e0, y0 + 0.5e0 FROM city_corners
UNION ALL SELECT codigo_ibge, 1, 0, x0 + 3e0, y0 + 0.5e0, x0 + 2.5e0, y0 FROM city_corners""",
    # power lines; some have no length
    "line_ends": """
SELECT s_suppkey + 1 AS id, s_name AS nome,
  -72e0 + ((s_suppkey * 7919) % 35000) / 1e3 AS x1, -32e0 + ((s_suppkey * 104729) % 35000) / 1e3 AS y1,
  -72e0 + ((s_suppkey * 7919) % 35000) / 1e3 + ((s_suppkey % 7) - 3) * 0.4e0 AS x2,
  -32e0 + ((s_suppkey * 104729) % 35000) / 1e3 + ((s_suppkey % 5) - 2) * 0.3e0 AS y2
FROM supplier""",
    "lines": """
SELECT id AS id_linha_transmissao, nome AS nome_linha,
  'LINESTRING (' || CAST(x1 AS STRING) || ' ' || CAST(y1 AS STRING) || ', '
  || CAST(x2 AS STRING) || ' ' || CAST(y2 AS STRING) || ')' AS geometria_wkt
FROM line_ends""",
    # roads: paths of three vertices
    "road_vertices": """
SELECT p_partkey + 1 AS id, 'BR-' || CAST(p_partkey % 500 AS STRING) AS sigla,
  -73e0 + ((p_partkey * 6971) % 37000) / 1e3 AS x1, -33e0 + ((p_partkey * 92821) % 37000) / 1e3 AS y1,
  -73e0 + ((p_partkey * 6971) % 37000) / 1e3 + 0.3e0 AS x2, -33e0 + ((p_partkey * 92821) % 37000) / 1e3 + 0.2e0 AS y2,
  -73e0 + ((p_partkey * 6971) % 37000) / 1e3 + 0.5e0 AS x3, -33e0 + ((p_partkey * 92821) % 37000) / 1e3 - 0.1e0 AS y3
FROM part""",
    "roads": """
SELECT id AS id_trecho_rodoviario, sigla AS codigo_rodovia,
  'LINESTRING (' || CAST(x1 AS STRING) || ' ' || CAST(y1 AS STRING) || ', '
  || CAST(x2 AS STRING) || ' ' || CAST(y2 AS STRING) || ', '
  || CAST(x3 AS STRING) || ' ' || CAST(y3 AS STRING) || ')' AS geometria_wkt
FROM road_vertices""",
    "substations": """
SELECT s_suppkey + 1 AS id_subestacao, 'SE ' || s_name AS nome_subestacao,
  -71e0 + ((s_suppkey * 48611) % 34000) / 1e3 AS longitude, -31e0 + ((s_suppkey * 22543) % 34000) / 1e3 AS latitude
FROM supplier""",
    "systems": """
SELECT CAST(n_nationkey + 1 AS BIGINT) AS id_sistema_isolado,
  -71e0 + ((n_nationkey * 31337) % 34000) / 1e3 AS longitude, -31e0 + ((n_nationkey * 27644) % 34000) / 1e3 AS latitude
FROM nation""",
    "hospitals": """
SELECT c_custkey + 1 AS codigo_cnes,
  -72e0 + ((c_custkey * 59359) % 36000) / 1e3 AS longitude, -32e0 + ((c_custkey * 70001) % 36000) / 1e3 AS latitude
FROM customer""",
    # land cover: one column per year
    "cover_wide": """
SELECT l.terr AS terr, CAST(l.cls AS STRING) AS class_id, l.biome AS biome,
  sum(CASE WHEN l.y = 1995 THEN l.q END) AS y1995, sum(CASE WHEN l.y = 1996 THEN l.q END) AS y1996,
  sum(CASE WHEN l.y = 1997 THEN l.q END) AS y1997, sum(CASE WHEN l.y = 1998 THEN l.q END) AS y1998,
  sum(CASE WHEN l.y = 1999 THEN l.q END) AS y1999, sum(CASE WHEN l.y = 2000 THEN l.q END) AS y2000,
  sum(CASE WHEN l.y = 2001 THEN l.q END) AS y2001
FROM (SELECT l_suppkey % 25 AS terr, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS cls,
        CASE WHEN l_suppkey % 3 = 0 THEN 'Amazônia' WHEN l_suppkey % 3 = 1 THEN 'Cerrado' END AS biome,
        year(l_shipdate) AS y,
        CASE WHEN l_suppkey % 25 = 3 AND year(l_shipdate) = 2001 THEN CAST(0 AS DECIMAL(18, 2))
             ELSE CAST(l_quantity AS DECIMAL(18, 2)) END AS q
      FROM lineitem) l
GROUP BY l.terr, l.cls, l.biome""",
    "cover_named": """
SELECT c.*, n.n_name || ' São' AS plain_name, n.n_name || ' é (' || CAST(c.terr AS STRING) || ')' AS coded_name,
  CASE WHEN c.terr % 7 = 0 THEN NULL ELSE 'Região ' || r.r_name END AS state, n.n_nationkey % 2 AS half
FROM cover_wide c JOIN nation n ON n.n_nationkey = c.terr JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "legend": """
SELECT '1' AS code, '1. Floresta' AS label UNION ALL SELECT '2', '2.1. Campo Alagado' UNION ALL SELECT '3', '3. Pastagem'
UNION ALL SELECT '4', '4.2. Área Urbana' UNION ALL SELECT '5', '9. Não observado' UNION ALL SELECT 'x', '5. Rio'
UNION ALL SELECT NULL, '1. Sem código' UNION ALL SELECT '6', NULL""",
    # health facilities, coordinates with a decimal comma
    "facilities": """
SELECT lpad(CAST(c_custkey AS STRING), 7, '0') AS CO_CNES,
  CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE c_name || ' Saúde' END AS NO_FANTASIA,
  CASE WHEN c_custkey % 41 = 0 THEN '999' ELSE lpad(CAST(c_nationkey AS STRING), 3, '0') END AS CO_MUNICIPIO_GESTOR,
  lpad(CAST(c_custkey % 7 AS STRING), 2, '0') AS TP_UNIDADE,
  CASE WHEN c_custkey % 3 = 0 THEN 'S' WHEN c_custkey % 3 = 1 THEN 'N' END AS TP_ESTAB_SEMPRE_ABERTO,
  CASE WHEN c_custkey % 53 = 0 THEN 'x'
       ELSE replace(CAST(-32e0 + ((c_custkey * 70001) % 36000) / 1e3 AS STRING), '.', ',') END AS NU_LATITUDE,
  CASE WHEN c_custkey % 59 = 0 THEN NULL
       ELSE replace(CAST(-72e0 + ((c_custkey * 59359) % 36000) / 1e3 AS STRING), '.', ',') END AS NU_LONGITUDE
FROM customer""",
    "facility_cities": """
SELECT lpad(CAST(n_nationkey AS STRING), 3, '0') AS CO_MUNICIPIO, n_name AS NO_MUNICIPIO,
  substr(r_name, 1, 2) AS CO_SIGLA_ESTADO
FROM nation JOIN region ON r_regionkey = n_regionkey""",
    "facility_types": """
SELECT DISTINCT lpad(CAST(c_custkey % 5 AS STRING), 2, '0') AS CO_TIPO_UNIDADE,
  'Tipo ' || CAST(c_custkey % 5 AS STRING) AS DS_TIPO_UNIDADE
FROM customer""",
    # popup texts of the power grid
    "popups": """
SELECT s_suppkey, CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE ' Linha é ' || s_name END AS Name,
  CASE WHEN s_suppkey % 11 = 0 THEN '<b>Nome: </b>sem dados'
       ELSE '<b>Tensão: </b>' || CAST(s_suppkey % 800 AS STRING) || ' Kv<br/><b>Extensão: </b>'
            || CAST(s_suppkey % 300 AS STRING) || ',' || CAST(s_suppkey % 10 AS STRING) || ' Km' END AS line_popup,
  CASE WHEN s_suppkey % 17 = 0 THEN '<b>Agente: </b>'
       ELSE '<B>capacidade:</B> ' || CAST(s_suppkey % 90 AS STRING) || ',5 MW<br/><b>Agente: </b> Companhia Elétrica '
            || CAST(s_suppkey % 9 AS STRING) || ' <br/>' END AS station_popup,
  CASE WHEN s_suppkey % 5 = 0 THEN 'sem estado' WHEN s_suppkey % 19 = 0 THEN NULL
       ELSE 'Vila - Afuá - ' || lower(substr(s_name, 1, 2)) || ' ' END AS system_popup
FROM supplier""",
    "metrics": """
SELECT ts AS __time, CASE WHEN event_type = 'click' THEN 'kafka_ingest_count' ELSE event_type END AS metric_name,
  CASE WHEN event_id % 2 = 0 THEN 'ms' ELSE 'count' END AS unit, value
FROM events""",
    # benchmark runs; the digits of event_id are independent
    "runs": """
SELECT CASE WHEN event_id % 6 = 4 THEN 'BI_2_FUNAI_Cenario' ELSE 'Bench_' || CAST(event_id % 6 AS STRING) || '_Cenario' END
    AS consulta,
  CASE WHEN CAST(floor(event_id / 6e0) AS BIGINT) % 2 = 0 THEN 'fragmentado' ELSE 'compactado' END AS armazenamento,
  CAST(2 + 2 * (CAST(floor(event_id / 12e0) AS BIGINT) % 3) AS INT) AS nucleos,
  CASE WHEN CAST(floor(event_id / 36e0) AS BIGINT) % 2 = 0 THEN 'cold' ELSE 'warm' END AS modo,
  CAST(1 + CAST(floor(event_id / 72e0) AS BIGINT) % 7 AS INT) AS rodada, value AS ms, event_id % 50 AS linhas
FROM events""",
}


def _depends(text: str, known: dict[str, str]) -> list[str]:
    return [n for n in known if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text)]


def with_ctes(text: str, known: dict[str, str]) -> str:
    """``text`` with the fixtures it reads, directly or not, as common table expressions."""
    ordered: list[str] = []

    def visit(body: str) -> None:
        for name in _depends(body, known):
            if name not in ordered:
                visit(known[name])
                ordered.append(name)

    visit(text)
    if not ordered:
        return text.strip()
    ctes = ",\n".join(f"{name} AS ({known[name].strip()})" for name in ordered)
    own = re.match(r"\s*WITH\s", text)
    return f"WITH {ctes},\n{text[own.end():].strip()}" if own else f"WITH {ctes}\n{text.strip()}"


def table_path(sf_dir: str, name: str) -> str:
    return str(Path(sf_dir) / f"{name}.parquet")


_LOADED: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its footer is read once per session."""
    key = (spark.sparkContext.applicationId, table_path(sf_dir, name))
    if key not in _LOADED:
        _LOADED[key] = spark.read.parquet(table_path(sf_dir, name))
    return _LOADED[key]


def fixture(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run ``text`` (a fixture name or a query over fixtures) on Spark."""
    query = with_ctes(f"SELECT * FROM {text}" if text in FIXTURES else text, FIXTURES)
    for name in TABLES:
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", query):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(query)


# ------------------------------------------------------------------------------------- DuckDB oracles

_F = 1 / 298.257222101
_E2 = _F * (2 - _F)


def _num(value: float) -> str:
    return f"{value:.17e}"


def projected(rows: str, lon: str, lat: str, x: str, y: str) -> str:
    """Query that adds the polyconic ``x, y`` of ``lon, lat`` to ``rows``."""
    a = 6378137.0
    m0 = 1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256
    m2 = 3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024
    m4 = 15 * _E2**2 / 256 + 45 * _E2**3 / 1024
    m6 = 35 * _E2**3 / 3072
    lam = f"radians({lon} + 54e0 - floor(({lon} + 54e0 + 180e0) / 360e0) * 360e0)"
    phi = f"radians({lat})"
    n = f"({_num(a)} / sqrt(1e0 - {_num(_E2)} * sin({phi}) * sin({phi})))"
    m = (
        f"({_num(a)} * ({_num(m0)} * {phi} - {_num(m2)} * sin(2e0 * {phi}) + {_num(m4)} * sin(4e0 * {phi})"
        f" - {_num(m6)} * sin(6e0 * {phi})))"
    )
    e = f"({lam} * sin({phi}))"
    return f"""SELECT *,
  CASE WHEN {lat} = 0 THEN 5e6 + {_num(a)} * {lam} ELSE 5e6 + {n} * sin({e}) / tan({phi}) END AS {x},
  CASE WHEN {lat} = 0 THEN 1e7 ELSE 1e7 + {m} + {n} * (1e0 - cos({e})) / tan({phi}) END AS {y}
FROM ({rows})"""


def _clean_text(c: str) -> str:
    """Hotspot text rule; DuckDB keeps the sharp s when it upper-cases."""
    t = f"replace(replace({c}, chr(10), ' '), chr(13), ' ')"
    return (
        f"CASE WHEN {c} IS NULL OR trim({t}) = '' THEN 'NAO INFORMADO' "
        f"ELSE strip_accents(upper(replace(trim({t}), 'ß', 'SS'))) END"
    )


def _metric(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) OR {c} <= -900 THEN 0e0 ELSE {c} END"


def _segment_mm(px: str, py: str) -> str:
    t = (
        f"greatest(0e0, least(1e0, coalesce((({px} - s.x1) * (s.x2 - s.x1) + ({py} - s.y1) * (s.y2 - s.y1))"
        " / nullif((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1), 0e0), 0e0)))"
    )
    dx, dy = f"({px} - s.x1 - (s.x2 - s.x1) * {t})", f"({py} - s.y1 - (s.y2 - s.y1) * {t})"
    return f"CAST(floor(sqrt({dx} * {dx} + {dy} * {dy}) * 1e3 + 0.5e0) AS BIGINT)"


def _nearest(segments: str, id_out: str, km_out: str) -> str:
    """Brute force: every point with every segment."""
    mm = _segment_mm("p.px", "p.py")
    return f"""
SELECT event_id, min(best).id AS {id_out}, floor((min(best).mm + 5000) / 10000e0) / 1e2 AS {km_out}
FROM (SELECT p.event_id, {{'mm': {mm}, 'id': s.id}} AS best FROM points p CROSS JOIN {segments} s
      WHERE NOT isnan(p.px) AND NOT isnan(p.py))
GROUP BY event_id"""


def _inside(edges: str, out: str) -> str:
    """Brute force: every point with every edge."""
    return f"""
SELECT event_id, min(id) AS {out} FROM (
  SELECT p.event_id, e.id,
    sum(CASE WHEN (e.y1 > p.lat) <> (e.y2 > p.lat)
              AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / nullif(e.y2 - e.y1, 0e0) + e.x1 THEN 1 ELSE 0 END) AS crossings,
    max(CASE WHEN (e.x2 - e.x1) * (p.lat - e.y1) - (e.y2 - e.y1) * (p.lon - e.x1) = 0
              AND p.lon BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
              AND p.lat BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2) THEN 1 ELSE 0 END) AS touch
  FROM points p CROSS JOIN {edges} e WHERE NOT isnan(p.lon) AND NOT isnan(p.lat)
  GROUP BY p.event_id, e.id)
WHERE crossings % 2 = 1 OR touch = 1 GROUP BY event_id"""


def _flat_segments(rows: str) -> str:
    start = projected(rows, "lon1", "lat1", "x1", "y1")
    return f"SELECT id, x1, y1, x2, y2 FROM ({projected(start, 'lon2', 'lat2', 'x2', 'y2')})"


def _point_rows(table: str, key: str) -> str:
    return (
        f"SELECT {key} AS id, longitude AS lon1, latitude AS lat1, longitude AS lon2, latitude AS lat2 FROM {table}"
    )


#: Day-first text is read where the month-first reading is impossible.
_READ = "coalesce(try_cast(DataHora AS TIMESTAMP), try_strptime(DataHora, '%m/%d/%Y %H:%M:%S'), try_strptime(DataHora, '%d/%m/%Y %H:%M:%S'))"
_TS = f"coalesce({_READ}, TIMESTAMP '1970-01-01 00:00:00')"

ORACLE: dict[str, str] = {
    **FIXTURES,
    "clean": f"""
SELECT event_id, {_TS} AS momento,
  coalesce(CAST(strftime({_READ}, '%Y%m%d') AS INTEGER), 0) AS id_data,
  strftime({_TS}, '%Y-%m-%d %H:%M:%S') AS data_hora,
  {_clean_text('Estado')} AS estado, {_clean_text('Municipio')} AS municipio,
  coalesce(Latitude, CAST('NaN' AS DOUBLE)) AS latitude, coalesce(Longitude, CAST('NaN' AS DOUBLE)) AS longitude,
  {_clean_text('Bioma')} AS bioma_inpe, Bioma AS bioma, {_clean_text('Satelite')} AS satelite_sensor,
  {_metric('DiaSemChuva')} AS dias_sem_chuva, {_metric('Precipitacao')} AS precipitacao_mm,
  {_metric('RiscoFogo')} AS risco_fogo_inpe, {_metric('FRP')} AS potencia_radiativa_fogo
FROM hotspots""",
    # a coordinate that is NaN makes the whole position unknown
    "points": projected(
        "SELECT event_id, CASE WHEN isnan(latitude) THEN latitude ELSE longitude END AS lon, "
        "CASE WHEN isnan(longitude) THEN longitude ELSE latitude END AS lat FROM clean",
        "lon", "lat", "px", "py",
    ),
    "line_segments": _flat_segments("SELECT id, x1 AS lon1, y1 AS lat1, x2 AS lon2, y2 AS lat2 FROM line_ends"),
    "road_segments": _flat_segments(
        "SELECT id, x1 AS lon1, y1 AS lat1, x2 AS lon2, y2 AS lat2 FROM road_vertices "
        "UNION ALL SELECT id, x2, y2, x3, y3 FROM road_vertices"
    ),
    "station_points": _flat_segments(_point_rows("substations", "id_subestacao")),
    "system_points": _flat_segments(_point_rows("systems", "id_sistema_isolado")),
    "hospital_points": _flat_segments(_point_rows("hospitals", "codigo_cnes")),
    "near_lines": _nearest("line_segments", "id_linha_transmissao", "distancia_linha_km"),
    "near_roads": _nearest("road_segments", "id_trecho_rodoviario", "distancia_rodovia_km"),
    "near_stations": _nearest("station_points", "id_subestacao", "distancia_subestacao_km"),
    "near_systems": _nearest("system_points", "id_sistema_isolado", "distancia_sistema_isolado_km"),
    "near_hospitals": _nearest("hospital_points", "codigo_cnes_prox", "distancia_hospital_km"),
    "in_lands": _inside("land_edges", "codigo_ti"),
    "in_cities": _inside("city_edges", "codigo_ibge_espacial"),
    "named": f"""
SELECT c.event_id, c.momento, c.municipio, c.estado, c.bioma, c.satelite_sensor AS satelite,
  CASE WHEN l.distancia_linha_km IS NULL THEN 'BAIXO' WHEN l.distancia_linha_km <= {ALTO_KM:e} THEN 'ALTO'
       WHEN l.distancia_linha_km <= {MEDIO_KM:e} THEN 'MEDIO' ELSE 'BAIXO' END AS risco_eletrico,
  CASE WHEN t.codigo_ti IS NULL THEN 'false' ELSE 'true' END AS em_terra_indigena,
  coalesce(lc.nome, 'Nenhuma') AS nome_ti, coalesce(le.nome, 'N/A') AS linha_afetada,
  c.potencia_radiativa_fogo, l.distancia_linha_km, s.distancia_subestacao_km
FROM clean c LEFT JOIN near_lines l USING (event_id) LEFT JOIN near_stations s USING (event_id)
LEFT JOIN in_lands t USING (event_id)
LEFT JOIN land_corners lc ON lc.codigo_ti = t.codigo_ti LEFT JOIN line_ends le ON le.id = l.id_linha_transmissao""",
    "fact": """
SELECT date_trunc('minute', momento) AS __time, municipio, estado, bioma, satelite, risco_eletrico, em_terra_indigena,
  nome_ti, linha_afetada, count(*) AS total_focos, max(potencia_radiativa_fogo) AS frp_maximo,
  min(distancia_linha_km) AS dist_linha_minima_km, min(distancia_subestacao_km) AS dist_subestacao_minima_km
FROM named GROUP BY ALL""",
}


def oracle(text: str) -> str:
    """A DuckDB query over fixtures and oracle tables as one statement over the test tables."""
    return with_ctes(text, ORACLE)


MERCATOR_Y = "ln(tan({pi4} + radians({lat}) / 2e0))".replace("{pi4}", _num(math.pi / 4))
