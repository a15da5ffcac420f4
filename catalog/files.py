"""Sources and sinks: the tables are written in a source's format and read back with the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.inputs import fact
from emberline.functions.geometry import wkt_from_parts
from emberline.schemas import ENRICHED_HOTSPOT, RAW_HOTSPOT
from emberline.session import scratch_path
from emberline.sources.dimensions import load_dimension
from emberline.sources.readers import (
    merge_geojson_pages,
    read_csv,
    read_facility_csv,
    read_geojson,
    read_geojson_lines,
    read_large_geojson,
    read_sheet,
)
from emberline.sources.storage import compact_by_year, write_fragments
from emberline.sources.versions import compact, newest, publish, read, replaced, stage
from emberline.sources.writers import event_json, geojson_collections, write_csv, write_geojson
from emberline.streaming.hotspots import parse_events
from catalog.tables import YEARS, legend, located, wide_cover
from catalog.spatial import ENRICHED
from fixtures import fixture, oracle


@query("scan_csv", oracle("SELECT * EXCLUDE (event_id) FROM hotspots"))
def _(spark, sf):
    path = scratch_path(spark, "hotspots-csv")
    hotspots = fixture(spark, sf, "hotspots").withColumnRenamed("event_id", "sobra")
    write_csv(hotspots.select(*reversed(hotspots.columns)), path)
    # columns are found by name, whatever their order and whatever else is there; cells may hold line ends
    return read_csv(spark, path, schema=RAW_HOTSPOT, multiline=True)


@query("scan_csv_split", oracle("SELECT * EXCLUDE (event_id) FROM hotspots"))
def _(spark, sf):
    # one file, whose cells hold line ends and quotes, read by byte ranges
    path = scratch_path(spark, "hotspots-one-csv")
    write_csv(fixture(spark, sf, "hotspots").drop("event_id").coalesce(1), path)
    return read_csv(spark, path, schema=RAW_HOTSPOT, multiline=True)


@query("scan_csv_latin1", oracle("SELECT * FROM facilities"))
def _(spark, sf):
    path = scratch_path(spark, "facilities-csv")
    write_csv(fixture(spark, sf, "facilities"), path, sep=";", encoding="ISO-8859-1")
    return read_facility_csv(spark, path)


_GEOJSON = oracle("""
SELECT camada, id, wkt FROM (
  SELECT 'terra' AS camada, CAST(codigo_ti AS VARCHAR) AS id, geometria_wkt AS wkt FROM lands
  UNION ALL SELECT 'municipio', CAST(codigo_ibge AS VARCHAR), geometria_wkt FROM cities
  UNION ALL SELECT 'linha', CAST(id_linha_transmissao AS VARCHAR), geometria_wkt FROM lines)""")
_SHAPES = """
SELECT 'terra' AS camada, CAST(codigo_ti AS STRING) AS id, geometria_wkt FROM lands
UNION ALL SELECT 'municipio', CAST(codigo_ibge AS STRING), geometria_wkt FROM cities
UNION ALL SELECT 'linha', CAST(id_linha_transmissao AS STRING), geometria_wkt FROM lines"""
# the oracle prints integral coordinates as 3.0, WKT as 3; artefacts of binary sums go beyond 6 decimals
_TIDY = r"regexp_replace(wkt, '\.0([ ,)])', '\1', 'g')"


def _features(df):
    return df.select("camada", "id", wkt_from_parts(F.col("geometry_type"), F.col("parts"), None).alias("wkt"))


@query("scan_geojson", f"SELECT camada, id, {_TIDY} AS wkt FROM ({_GEOJSON})")
def _(spark, sf):
    path = scratch_path(spark, "collections")
    pages = geojson_collections(fixture(spark, sf, _SHAPES), ["camada", "id"], per_page=500)
    pages.select("page", "value").write.partitionBy("page").text(path)
    return _features(read_geojson(spark, path, ["camada", "id"]))


@query("scan_geojson_split", f"SELECT camada, id, {_TIDY} AS wkt FROM ({_GEOJSON})")
def _(spark, sf):
    # all features in one document
    path = scratch_path(spark, "one-collection")
    document = geojson_collections(fixture(spark, sf, _SHAPES), ["camada", "id"], per_page=1 << 30)
    document.select("value").write.text(path)
    return _features(read_large_geojson(spark, path, ["camada", "id"]))


@query("sink_geojson", f"SELECT camada, id, {_TIDY} AS wkt FROM ({_GEOJSON})")
def _(spark, sf):
    path = scratch_path(spark, "features")
    write_geojson(fixture(spark, sf, _SHAPES), path)
    return _features(read_geojson_lines(spark, path, ["camada", "id"]))


@query("merge_geojson_pages", oracle("""
SELECT CAST(codigo_cnes AS VARCHAR) AS codigo_cnes, longitude, latitude FROM hospitals
WHERE CAST(floor((codigo_cnes - 1) / 40e0) AS BIGINT) <= (
  SELECT min(p) FROM (SELECT CAST(floor((codigo_cnes - 1) / 40e0) AS BIGINT) AS p, count(*) AS n FROM hospitals
                      WHERE CAST(floor((codigo_cnes - 1) / 40e0) AS BIGINT) <> 3 OR codigo_cnes % 2 = 0 GROUP BY 1)
  WHERE n < 40 OR p = (SELECT max(CAST(floor((codigo_cnes - 1) / 40e0) AS BIGINT)) FROM hospitals))
AND (CAST(floor((codigo_cnes - 1) / 40e0) AS BIGINT) <> 3 OR codigo_cnes % 2 = 0)"""))
def _(spark, sf):
    # pages of 40 features; page 3 lost half of its features, so it counts as the last one
    path = scratch_path(spark, "pages")
    rows = fixture(spark, sf, """
SELECT codigo_cnes, CAST(floor((codigo_cnes - 1) / 40e0) AS BIGINT) AS page, longitude, latitude FROM hospitals
WHERE CAST(floor((codigo_cnes - 1) / 40e0) AS BIGINT) <> 3 OR codigo_cnes % 2 = 0""")
    feature = F.format_string(
        '{"type":"Feature","properties":{"codigo_cnes":"%s"},"geometry":{"type":"Point","coordinates":[%s,%s]}}',
        "codigo_cnes", F.col("longitude").cast("string"), F.col("latitude").cast("string"),
    )
    pages = rows.groupBy("page").agg(F.array_join(F.collect_list(feature), ",").alias("f"))
    documents = pages.select(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("value"), "page"
    )
    documents.write.partitionBy("page").text(path)
    merged = merge_geojson_pages(spark, path, ["codigo_cnes"], page_size=40)
    vertex = F.col("parts")[0][0][0]
    return merged.select("codigo_cnes", vertex["x"].alias("longitude"), vertex["y"].alias("latitude"))


@query("scan_landcover", oracle("SELECT coded_name AS indigenous_territories, state, biome, class_id, " + ", ".join(
    f'CAST(y{y} AS VARCHAR) AS "{y}"' for y in YEARS
) + " FROM cover_named"))
def _(spark, sf):
    path = scratch_path(spark, "sheet")
    wide = wide_cover(spark, sf, "indigenous_territories", "coded_name")
    write_csv(wide.select("indigenous_territories", "state", "biome", "class_id", *YEARS), path)
    return read_sheet(spark, path)


@query("scan_legend_with_titles", oracle("SELECT code AS \"Code ID\", label AS \"COLEÇÃO 10 - CLASSES\" FROM legend"))
def _(spark, sf):
    path = scratch_path(spark, "legend-sheet")
    cell = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))
    body = legend(spark, sf).select(F.lit(5).alias("k"), F.concat_ws(",", cell("Code ID"), cell("COLEÇÃO 10 - CLASSES")).alias("value"))
    titles = ["Legenda", "Coleção 10", "", '"Code ID","COLEÇÃO 10 - CLASSES"']
    head = spark.createDataFrame(list(enumerate(titles)), "k int, value string")
    # a sheet is one file
    head.unionByName(body).orderBy("k").coalesce(1).select("value").write.text(path)
    return read_sheet(spark, path, skip_rows=3)


@query("roundtrip_csv", oracle("""
SELECT municipio || chr(10) || '"' || bioma || '"' AS rotulo, CAST(sum(total_focos) AS VARCHAR) AS total_focos
FROM fact GROUP BY municipio, bioma"""))
def _(spark, sf):
    path = scratch_path(spark, "result")
    totals = fact(spark, sf).groupBy("municipio", "bioma").agg(F.sum("total_focos").alias("total_focos"))
    write_csv(totals.select(F.expr("concat(municipio, chr(10), '\"', bioma, '\"')").alias("rotulo"), "total_focos"), path)
    return read_csv(spark, path, multiline=True)


@query("event_json", oracle(ENRICHED.replace("SELECT event_id, id_data", "SELECT id_data", 1)))
def _(spark, sf):
    return parse_events(event_json(located(spark, sf).drop("event_id")), ENRICHED_HOTSPOT)


@query("load_dimension", oracle("""
SELECT TIMESTAMP '2025-01-01 00:00:00' AS __time, try_cast(CO_CNES AS BIGINT) AS codigo_cnes, NO_FANTASIA AS nome_hospital,
  CAST(NULL AS VARCHAR) AS tipo_unidade, TP_ESTAB_SEMPRE_ABERTO AS funciona_24h,
  try_cast(CO_MUNICIPIO_GESTOR AS BIGINT) AS codigo_ibge_municipio, CAST(NULL AS VARCHAR) AS municipios_nome,
  CAST(NULL AS VARCHAR) AS estado_sigla, try_cast(replace(NU_LATITUDE, ',', '.') AS DOUBLE) AS latitude,
  try_cast(replace(NU_LONGITUDE, ',', '.') AS DOUBLE) AS longitude FROM facilities"""))
def _(spark, sf):
    base = scratch_path(spark, "dimensions")
    raw = fixture(spark, sf, """
SELECT 'x' AS sobra, NO_FANTASIA AS nome_hospital, CO_CNES AS codigo_cnes, TP_ESTAB_SEMPRE_ABERTO AS funciona_24h,
  CO_MUNICIPIO_GESTOR AS codigo_ibge_municipio, replace(NU_LATITUDE, ',', '.') AS latitude,
  replace(NU_LONGITUDE, ',', '.') AS longitude FROM facilities""")
    write_csv(raw, f"{base}/csv")
    return load_dimension(spark, f"{base}/csv", "dim_hospitais_cnes", f"{base}/table", glob="*.csv")


def shipments(spark, sf):
    return fixture(spark, sf, """
SELECT CAST(l_shipdate AS TIMESTAMP) AS __time, l_returnflag AS risco_eletrico, l_linestatus AS bioma, l_quantity AS quantidade
FROM lineitem""")


@query("compact_yearly", """
SELECT year(l_shipdate) AS year, l_returnflag AS risco_eletrico, count(*) AS linhas, sum(l_quantity) AS quantidade
FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    base = scratch_path(spark, "compaction")
    write_fragments(shipments(spark, sf), f"{base}/fragments", files=64)
    compacted = compact_by_year(spark, f"{base}/fragments", f"{base}/years")
    return compacted.groupBy("year", "risco_eletrico").agg(
        F.count(F.lit(1)).alias("linhas"), F.sum("quantidade").alias("quantidade")
    )


@query("compact_small_files", """
SELECT CAST(l_shipdate AS TIMESTAMP) AS __time, l_returnflag AS risco_eletrico, l_linestatus AS bioma, l_quantity AS quantidade, year(l_shipdate) AS ano
FROM lineitem""")
def _(spark, sf):
    """A versioned table of many small files in three commits, compacted in place."""
    path, rows = scratch_path(spark, "versioned"), shipments(spark, sf).withColumn("ano", F.year("__time"))
    for part in range(3):
        chosen = rows.filter(F.pmod(F.hash("quantidade"), F.lit(3)) == part)
        base = newest(spark, path)
        publish(spark, path, base, {"data": replaced(base, "data", stage(chosen.repartition(4), path, "data", ["ano"]), ())})
    compact(spark, path, sort=["risco_eletrico", "bioma"])
    return read(spark, path)
