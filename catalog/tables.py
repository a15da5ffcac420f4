"""Column selection, defaults, ids, lookups and land-cover tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.inputs import cleaned, context
from emberline.functions.columns import drop_missing, fill_defaults, tolerant_select
from emberline.operators.ids import surrogate_id
from emberline.operators.landcover import clean_legend, cover_history, latest_cover
from emberline.operators.lookups import cover_by_territory, legend_join, locality_lookup, star_lookup
from emberline.operators.rollup import NO_LAND, NO_LINE
from emberline.plans.enrichment import enriched_record, locate
from emberline.plans.infrastructure_dims import HOSPITAL_COLUMNS, HOSPITAL_DEFAULTS
from emberline.plans.landcover_dims import INDIGENOUS_LANDS, land_cover_dimension
from emberline.plans.territory_dims import LAND_COLUMNS
from fixtures import fixture, oracle

YEARS = [str(y) for y in range(1995, 2002)]


def wide_cover(spark, sf, name: str, column: str, class_column: str = "class_id", **constants: str):
    """The yearly land-cover sheet of one territory kind, with the source's column names."""
    wide = fixture(spark, sf, "cover_named").withColumnsRenamed({f"y{y}": y for y in YEARS})
    return wide.select(
        F.col(column).alias(name), "state", "biome", F.col("class_id").alias(class_column),
        *[F.lit(v).alias(k) for k, v in constants.items()], *YEARS,
    )


def legend(spark, sf):
    return fixture(spark, sf, "legend").withColumnsRenamed({"code": "Code ID", "label": "COLEÇÃO 10 - CLASSES"})


@query("fill_defaults", oracle("""
SELECT CO_CNES, coalesce(NO_FANTASIA, 'NÃO INFORMADO') AS NO_FANTASIA,
  coalesce(TP_ESTAB_SEMPRE_ABERTO, 'N') AS TP_ESTAB_SEMPRE_ABERTO, 'TIPO NÃO INFORMADO' AS DS_TIPO_UNIDADE
FROM facilities"""))
def _(spark, sf):
    rows = fixture(spark, sf, "facilities").select("CO_CNES", "NO_FANTASIA", "TP_ESTAB_SEMPRE_ABERTO")
    wanted = ("NO_FANTASIA", "TP_ESTAB_SEMPRE_ABERTO", "DS_TIPO_UNIDADE")
    return fill_defaults(rows, {c: HOSPITAL_DEFAULTS[c] for c in wanted})


@query("tolerant_select", oracle("""
SELECT codigo_ti, nome_terra_indigena, uf AS estado, geometria_wkt
FROM (SELECT *, 'UF' || CAST(codigo_ti % 27 AS STRING) AS uf FROM lands)"""))
def _(spark, sf):
    raw = fixture(spark, sf, """
SELECT 'x' AS sobra, geometria_wkt AS the_geom, 'UF' || CAST(codigo_ti % 27 AS STRING) AS uf_sigla,
  nome_terra_indigena AS terrai_nome, codigo_ti AS terrai_codigo FROM lands""")
    return tolerant_select(raw, LAND_COLUMNS, LAND_COLUMNS)


@query("drop_missing", oracle("""
SELECT CO_CNES, NO_FANTASIA, NU_LATITUDE, NU_LONGITUDE FROM facilities
WHERE NO_FANTASIA IS NOT NULL AND NU_LONGITUDE IS NOT NULL"""))
def _(spark, sf):
    rows = tolerant_select(fixture(spark, sf, "facilities"), HOSPITAL_COLUMNS)
    return drop_missing(rows, ["NO_FANTASIA", "NU_LONGITUDE"]).select(
        "CO_CNES", "NO_FANTASIA", "NU_LATITUDE", "NU_LONGITUDE"
    )


@query("surrogate_id", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders")
def _(spark, sf):
    orders = fixture(spark, sf, "SELECT o_orderkey, o_orderdate FROM orders")
    return surrogate_id(orders, ["o_orderdate", "o_orderkey"], "id").select("o_orderkey", "id")


_LATEST = "SELECT *, CAST(y2001 AS DOUBLE) AS area_hectares FROM cover_named WHERE y2001 > 0"


@query("latest_year_cover", oracle(f"""
SELECT coded_name AS indigenous_territories, state, biome, CAST(class_id AS BIGINT) AS class_id, area_hectares
FROM ({_LATEST})"""))
def _(spark, sf):
    wide = wide_cover(spark, sf, "indigenous_territories", "coded_name")
    return latest_cover(wide, ["indigenous_territories", "state", "biome"])


@query("cover_history", oracle(" UNION ALL ".join(
    f"SELECT coded_name AS indigenous_territories, class_id, biome, {y} AS ano, CAST(y{y} AS DOUBLE) AS area_hectares FROM cover_named"
    for y in YEARS
)))
def _(spark, sf):
    wide = wide_cover(spark, sf, "indigenous_territories", "coded_name")
    return cover_history(wide, ["indigenous_territories", "class_id", "biome"])


MACRO = """CASE substr(label, 1, 2) WHEN '1.' THEN '1. Floresta' WHEN '2.' THEN '2. Vegetação Não Florestal'
  WHEN '3.' THEN '3. Agropecuária' WHEN '4.' THEN '4. Área não Vegetada' WHEN '5.' THEN '5. Corpo D''água' ELSE 'Outros' END"""
LEGEND = f"SELECT try_cast(code AS BIGINT) AS class_id, label, {MACRO} AS macro FROM legend WHERE code IS NOT NULL AND label IS NOT NULL"


@query("join_legend", oracle(f"""
SELECT c.coded_name AS territorio, c.class_id, c.area_hectares, l.label AS uso_cobertura_solo, l.macro AS categoria_macro
FROM (SELECT * REPLACE (CAST(class_id AS BIGINT) AS class_id) FROM ({_LATEST})) c
LEFT JOIN ({LEGEND}) l ON l.class_id IS NOT DISTINCT FROM c.class_id"""))
def _(spark, sf):
    wide = wide_cover(spark, sf, "territorio", "coded_name")
    joined = legend_join(
        latest_cover(wide, ["territorio"]), clean_legend(legend(spark, sf), "Code ID", "COLEÇÃO 10 - CLASSES")
    )
    return joined.select("territorio", "class_id", "area_hectares", "uso_cobertura_solo", "categoria_macro")


def located(spark, sf):
    return enriched_record(locate(cleaned(spark, sf), context(spark, sf)), "event_id")


@query("star_lookup", oracle("""
SELECT event_id, coalesce(lc.nome, 'Nenhuma') AS nome_ti, coalesce(le.nome, 'N/A') AS linha_afetada,
  coalesce(se.nome_subestacao, 'N/A') AS subestacao, coalesce(ci.nome, 'N/A') AS municipio_espacial
FROM clean LEFT JOIN near_lines nl USING (event_id) LEFT JOIN near_stations ns USING (event_id)
LEFT JOIN in_lands il USING (event_id) LEFT JOIN in_cities ic USING (event_id)
LEFT JOIN land_corners lc ON lc.codigo_ti = il.codigo_ti LEFT JOIN line_ends le ON le.id = nl.id_linha_transmissao
LEFT JOIN substations se ON se.id_subestacao = ns.id_subestacao
LEFT JOIN city_corners ci ON ci.codigo_ibge = ic.codigo_ibge_espacial"""))
def _(spark, sf):
    named = star_lookup(located(spark, sf), [
        ("codigo_ti", fixture(spark, sf, "lands"), "codigo_ti", "nome_terra_indigena", "nome_ti", NO_LAND),
        ("id_linha_transmissao", fixture(spark, sf, "lines"), "id_linha_transmissao", "nome_linha", "linha_afetada", NO_LINE),
        ("id_subestacao", fixture(spark, sf, "substations"), "id_subestacao", "nome_subestacao", "subestacao", "N/A"),
        ("codigo_ibge_espacial", fixture(spark, sf, "cities"), "codigo_ibge", "nome", "municipio_espacial", "N/A"),
    ])
    return named.select("event_id", "nome_ti", "linha_afetada", "subestacao", "municipio_espacial")


@query("landcover_by_territory", oracle(f"""
SELECT 'TERRA ' || t.n AS nome, t.codigo_ti, c.macro AS categoria_macro, c.area_hectares
FROM (SELECT n_name AS n, CAST(n_nationkey + 1 AS BIGINT) AS codigo_ti FROM nation) t
JOIN (SELECT strip_accents(upper(trim(split_part(coded_name, '(', 1)))) AS nome, coalesce(l.macro, 'NAO INFORMADO') AS macro,
        CAST(sum(y2001) AS DOUBLE) AS area_hectares
      FROM (SELECT * REPLACE (CAST(class_id AS BIGINT) AS class_id) FROM ({_LATEST})) a
      LEFT JOIN ({LEGEND}) l ON l.class_id IS NOT DISTINCT FROM a.class_id GROUP BY 1, 2) c
ON c.nome = t.n || ' E'"""))
def _(spark, sf):
    cover = land_cover_dimension(INDIGENOUS_LANDS, wide_cover(spark, sf, "indigenous_territories", "coded_name"), legend(spark, sf))
    lands = fixture(spark, sf, """
SELECT CAST(n_nationkey + 1 AS BIGINT) AS codigo_ti, n_name || ' E' AS nome_limpo, 'TERRA ' || n_name AS nome FROM nation""")
    joined = cover_by_territory(lands, cover, "nome_limpo", "nome_ti_limpo")
    return joined.select("nome", "codigo_ti", "categoria_macro", "area_hectares")


_LOCALITIES = """
SELECT 'ESTADO ' || CAST(k % 3 AS STRING) || '_SAO JOAO ' || CAST(k % 4 AS STRING) AS chave_localidade, 100 + k AS codigo_ibge,
  -10e0 - k AS lat_centroide FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation)"""


@query("locality_lookup", oracle(f"""
SELECT event_id, estado || '_' || municipio AS chave_localidade, m.codigo_ibge, m.lat_centroide
FROM clean LEFT JOIN (
  SELECT chave_localidade, min(codigo_ibge) AS codigo_ibge, arg_min(lat_centroide, codigo_ibge) AS lat_centroide FROM ({_LOCALITIES}) GROUP BY 1
) m ON m.chave_localidade = estado || '_' || municipio"""))
def _(spark, sf):
    hotspots = cleaned(spark, sf).select("event_id", "chave_localidade")
    return locality_lookup(hotspots, fixture(spark, sf, _LOCALITIES), ["codigo_ibge", "lat_centroide"])
