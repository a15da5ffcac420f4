"""The dimension jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import LEGEND, _LATEST, legend, wide_cover
from catalog.spatial import _CENTROID, _n
from catalog.scalars import _POPUP_ORACLE, _STATES
from emberline.functions.geometry import parts_from_wkt, wkt_kind
from emberline.plans.infrastructure_dims import hospitals, isolated_systems, roads, substations, transmission_lines
from emberline.plans.landcover_dims import (
    INDIGENOUS_LANDS,
    MUNICIPALITIES,
    PROTECTED_AREAS,
    QUILOMBOS,
    land_cover_dimension,
)
from emberline.plans.territory_dims import indigenous_lands, municipalities
from emberline.schemas import DIMENSIONS
from emberline.sources.dimensions import typed_dimension
from fixtures import fixture, oracle

_JOINED = f"""(SELECT * REPLACE (CAST(class_id AS BIGINT) AS class_id) FROM ({_LATEST})) c
LEFT JOIN ({LEGEND}) l ON l.class_id IS NOT DISTINCT FROM c.class_id"""
_TAIL = """coalesce(strip_accents(upper(c.state)), '') AS estado_norm,
  coalesce(strip_accents(upper(c.biome)), '') AS bioma_norm, c.class_id AS id_classe_solo,
  coalesce(l.macro, 'NAO INFORMADO') AS categoria_macro, coalesce(l.label, 'NAO INFORMADO') AS uso_cobertura_solo,
  c.area_hectares"""
_CODED = "strip_accents(upper(trim(split_part(c.coded_name, '(', 1))))"


@query("dim_mapbiomas_municipios", oracle(f"""
SELECT coalesce(strip_accents(upper(c.state)), '') || '_' || strip_accents(upper(c.plain_name)) AS chave_localidade,
  strip_accents(upper(c.plain_name)) AS municipio_norm, {_TAIL} FROM {_JOINED}"""))
def _(spark, sf):
    return land_cover_dimension(MUNICIPALITIES, wide_cover(spark, sf, "municipality", "plain_name"), legend(spark, sf))


@query("dim_mapbiomas_terras_indigenas", oracle(f"SELECT {_CODED} AS nome_ti_limpo, {_TAIL} FROM {_JOINED}"))
def _(spark, sf):
    wide = wide_cover(spark, sf, "indigenous_territories", "coded_name")
    return land_cover_dimension(INDIGENOUS_LANDS, wide, legend(spark, sf))


@query("dim_mapbiomas_quilombos", oracle(f"SELECT {_CODED} AS nome_quilombo_limpo, {_TAIL} FROM {_JOINED}"))
def _(spark, sf):
    return land_cover_dimension(QUILOMBOS, wide_cover(spark, sf, "quilombo_territory", "coded_name"), legend(spark, sf))


@query("dim_mapbiomas_unidades_conservacao", oracle(f"""
SELECT {_CODED} AS nome_uc_limpo, 'Federal' AS esfera_governamental, 'Uso Sustentável' AS tipo_uso, 'RESEX' AS categoria_uc,
  {_TAIL} FROM {_JOINED}"""))
def _(spark, sf):
    wide = wide_cover(
        spark, sf, "protected_area_name", "coded_name", class_column="class", protected_area_political_level="Federal",
        protected_area_use_type="Uso Sustentável", protected_area_type="RESEX",
    )
    return land_cover_dimension(PROTECTED_AREAS, wide, legend(spark, sf))


def features(df, wkt="geometria_wkt"):
    """Rows with a WKT column in the shape the GeoJSON reader gives."""
    g = F.col(wkt)
    return df.select("*", wkt_kind(g).alias("geometry_type"), parts_from_wkt(g).alias("parts")).drop(wkt)


def _wkt6(c: str) -> str:
    """A WKT text whose numbers are printed with at most 6 decimals."""
    numbers = f"list_transform(regexp_extract_all({c}, '-?[0-9.]+'), lambda t: {_n('CAST(t AS DOUBLE)')})"
    texts = f"regexp_split_to_array({c}, '-?[0-9.]+')"
    return f"array_to_string(list_transform(list_zip({texts}, list_concat({numbers}, [''])), lambda z: z[1] || z[2]), '')"


@query("dim_municipios_coordenadas", oracle(f"""
{_CENTROID.strip().rsplit('SELECT camada, id, round', 1)[0].rstrip()},
centres AS (SELECT camada, id, round{_CENTROID.strip().rsplit('SELECT camada, id, round', 1)[1]})
SELECT CAST(codigo_ibge AS VARCHAR) AS codigo_ibge, {_STATES.replace('codigo,', 'CAST(codigo_ibge AS VARCHAR),')} || '_'
    || strip_accents(upper(trim(nome))) AS chave_localidade,
  {_STATES.replace('codigo,', 'CAST(codigo_ibge AS VARCHAR),')} AS estado_nome, strip_accents(upper(trim(nome))) AS municipios_nome,
  lat_centroide, lon_centroide, {_wkt6('geometria_wkt')} AS geometria_wkt
FROM cities JOIN centres ON camada = 'municipio' AND id = codigo_ibge"""))
def _(spark, sf):
    cities = fixture(spark, sf, """
SELECT CAST(NULL AS STRING) AS feature_id, ' ' || CAST(codigo_ibge AS STRING) AS id, nome AS name, geometria_wkt FROM cities""")
    return municipalities(features(cities))


@query("dim_terras_indigenas_funai", oracle("""
SELECT TIMESTAMP '2025-01-01 00:00:00' AS __time, codigo_ti, strip_accents(upper(nome_terra_indigena)) AS nome_terra_indigena,
  CAST(NULL AS VARCHAR) AS etnia, CAST(NULL AS VARCHAR) AS municipios, 'AM' AS estado, codigo_ti * 1.5e0 AS area_hectares,
  CAST(NULL AS VARCHAR) AS estagio_regularizacao, CAST(NULL AS VARCHAR) AS modalidade, CAST(NULL AS VARCHAR) AS em_faixa_fronteira,
  geometria_wkt FROM lands"""))
def _(spark, sf):
    raw = fixture(spark, sf, """
SELECT geometria_wkt AS the_geom, CAST(codigo_ti AS STRING) AS terrai_codigo, nome_terra_indigena AS terrai_nome,
  'AM' AS uf_sigla, CAST(codigo_ti * 1.5e0 AS STRING) AS superficie_perimetro_ha FROM lands""")
    return typed_dimension(indigenous_lands(raw), "dim_terras_indigenas_funai")


@query("dim_rodovias_federais", oracle(r"""
SELECT id_trecho_rodoviario, strip_accents(upper(codigo_rodovia)) AS codigo_rodovia, 'NAO INFORMADO' AS jurisdicao,
  'PAVIMENTACAO' AS revestimento, regexp_replace(geometria_wkt, '\.0([ ,)])', '\1', 'g') AS geometria_wkt FROM roads"""))
def _(spark, sf):
    raw = fixture(spark, sf, """
SELECT CAST(id_trecho_rodoviario AS STRING) AS ID, lower(codigo_rodovia) AS vl_br, CAST(NULL AS STRING) AS ds_jurisdi,
  ' Pavimentação' AS ds_revesti, geometria_wkt FROM roads""")
    return roads(features(raw))


_LINE_ROWS = f"""
SELECT coalesce(strip_accents(upper(trim(Name))), 'NAO INFORMADO') AS nome_linha, tensao_kv, extensao_km,
  {_wkt6('geometria_wkt')} AS geometria_wkt
FROM popups JOIN ({_POPUP_ORACLE.strip()}) p USING (s_suppkey) JOIN lines ON id_linha_transmissao = s_suppkey + 1"""


@query("dim_ons_linhas_transmissao", oracle(f"""
SELECT row_number() OVER (ORDER BY nome_linha, tensao_kv, extensao_km, geometria_wkt) AS id_linha_transmissao, *
FROM ({_LINE_ROWS})"""))
def _(spark, sf):
    raw = fixture(spark, sf, """
SELECT Name, line_popup AS PopupInfo, geometria_wkt FROM popups JOIN lines ON id_linha_transmissao = s_suppkey + 1""")
    return transmission_lines(features(raw))


@query("dim_ons_subestacoes", oracle(f"""
SELECT row_number() OVER (ORDER BY nome_subestacao, capacidade_mw, agente_responsavel, latitude, longitude) AS id_subestacao, *
FROM (SELECT coalesce(strip_accents(upper(trim(Name))), 'NAO INFORMADO') AS nome_subestacao, capacidade_mw,
  agente AS agente_responsavel, latitude, longitude
  FROM popups JOIN ({_POPUP_ORACLE.strip()}) p USING (s_suppkey) JOIN substations ON id_subestacao = s_suppkey + 1)"""))
def _(spark, sf):
    raw = fixture(spark, sf, """
SELECT Name, station_popup AS PopupInfo, 'POINT (' || CAST(longitude AS STRING) || ' ' || CAST(latitude AS STRING) || ')' AS geometria_wkt
FROM popups JOIN substations ON id_subestacao = s_suppkey + 1""")
    return substations(features(raw))


@query("dim_ons_sistemas_isolados", oracle(f"""
SELECT row_number() OVER (ORDER BY nome_sistema_isolado, estado_sigla, latitude, longitude) AS id_sistema_isolado, *,
  'POINT (' || {_n('longitude')} || ' ' || {_n('latitude')} || ')' AS geometria_wkt
FROM (SELECT coalesce(strip_accents(upper(trim(Name))), 'NAO INFORMADO') AS nome_sistema_isolado,
  CASE WHEN contains(system_popup, '-') THEN upper(trim(split_part(system_popup, '-', -1))) ELSE 'NA' END AS estado_sigla,
  round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM popups JOIN substations ON id_subestacao = s_suppkey + 1)"""))
def _(spark, sf):
    raw = fixture(spark, sf, """
SELECT Name, system_popup AS PopupInfo, 'POINT (' || CAST(longitude AS STRING) || ' ' || CAST(latitude AS STRING) || ')' AS geometria_wkt
FROM popups JOIN substations ON id_subestacao = s_suppkey + 1""")
    return isolated_systems(features(raw))


_HOSPITALS = """
SELECT CO_CNES AS codigo_cnes, coalesce(NO_FANTASIA, 'NÃO INFORMADO') AS nome_hospital,
  coalesce(DS_TIPO_UNIDADE, 'TIPO NÃO INFORMADO') AS tipo_unidade, coalesce(TP_ESTAB_SEMPRE_ABERTO, 'N') AS funciona_24h,
  CO_MUNICIPIO_GESTOR AS codigo_ibge_municipio, coalesce(NO_MUNICIPIO, 'DESCONHECIDO') AS municipios_nome,
  coalesce(CO_SIGLA_ESTADO, 'NI') AS estado_sigla, try_cast(replace(NU_LATITUDE, ',', '.') AS DOUBLE) AS latitude,
  try_cast(replace(NU_LONGITUDE, ',', '.') AS DOUBLE) AS longitude
FROM facilities LEFT JOIN facility_cities ON CO_MUNICIPIO = CO_MUNICIPIO_GESTOR
LEFT JOIN facility_types ON CO_TIPO_UNIDADE = TP_UNIDADE
WHERE try_cast(replace(NU_LATITUDE, ',', '.') AS DOUBLE) IS NOT NULL
  AND try_cast(replace(NU_LONGITUDE, ',', '.') AS DOUBLE) IS NOT NULL"""


@query("dim_hospitais_cnes", oracle(_HOSPITALS))
def _(spark, sf):
    return hospitals(
        fixture(spark, sf, "facilities"), fixture(spark, sf, "facility_cities"), fixture(spark, sf, "facility_types")
    )


@query("join_facilities", oracle(f"SELECT estado_sigla, tipo_unidade, count(*) AS unidades FROM ({_HOSPITALS}) GROUP BY 1, 2"))
def _(spark, sf):
    joined = hospitals(
        fixture(spark, sf, "facilities"), fixture(spark, sf, "facility_cities"), fixture(spark, sf, "facility_types")
    )
    return joined.groupBy("estado_sigla", "tipo_unidade").agg(F.count(F.lit(1)).alias("unidades"))


@query("dim_rodovias_second_scheme", oracle(r"""
SELECT row_number() OVER (ORDER BY codigo_rodovia, jurisdicao, revestimento, tipo_pavimento, situacao_fisica, status_operacional, geometria_wkt)
    AS id_trecho_rodoviario, *
FROM (SELECT strip_accents(upper(codigo_rodovia)) AS codigo_rodovia, 'FEDERAL' AS jurisdicao, 'ASFALTO' AS revestimento,
        'TIPO ' || CAST(id_trecho_rodoviario % 3 AS VARCHAR) AS tipo_pavimento, 'NAO INFORMADO' AS situacao_fisica, 'SIM' AS status_operacional,
        regexp_replace(geometria_wkt, '\.0([ ,)])', '\1', 'g') AS geometria_wkt FROM roads)"""))
def _(spark, sf):
    raw = fixture(spark, sf, """
SELECT lower(codigo_rodovia) AS sigla, 'Federal' AS jurisdicao, 'outro' AS ds_jurisdi, ' Asfalto ' AS revestimen,
  'tipo ' || CAST(id_trecho_rodoviario % 3 AS STRING) AS tipopavime, CAST(NULL AS STRING) AS situacaofi, 'sim' AS operaciona,
  geometria_wkt FROM roads""")
    return roads(features(raw))


def _cells(spec, number, text, bad, whole):
    """Cells of a raw dimension file, column by column: bad numbers, whole numbers written as decimals, one column absent."""
    for j, field in enumerate(spec.schema.fields[:-1]):
        kind = field.dataType.simpleString()
        if kind == "bigint":
            yield f"CASE WHEN (s_suppkey + {j}) % 7 = 0 THEN {bad} WHEN (s_suppkey + {j}) % 5 = 0 THEN {whole} ELSE {number} END AS {field.name}"
        elif kind == "double":
            yield f"CASE WHEN (s_suppkey + {j}) % 7 = 0 THEN {bad} ELSE {text.format(number=number)} END AS {field.name}"
        else:
            yield f"'v ' || CAST(s_suppkey + {j} AS STRING) AS {field.name}"


def _typed(name, spec):
    last = spec.schema.fields[-1]
    raw = "SELECT " + ", ".join(_cells(spec, "CAST(s_suppkey AS STRING)", "{number} || '.25'", "'x'", "CAST(s_suppkey AS STRING) || '.0'")) + " FROM supplier"
    typed = ", ".join(_cells(spec, "CAST(s_suppkey AS BIGINT)", "{number} + 0.25e0", "NULL", "CAST(s_suppkey AS BIGINT)"))
    kind = {"bigint": "BIGINT", "double": "DOUBLE"}.get(last.dataType.simpleString(), "VARCHAR")
    want = f"SELECT TIMESTAMP '{spec.time}' AS __time, {typed}, CAST(NULL AS {kind}) AS {last.name} FROM supplier"
    query(f"typed_{name}", oracle(want))(lambda spark, sf: typed_dimension(fixture(spark, sf, raw), name))


for _name, _spec in DIMENSIONS.items():
    _typed(_name, _spec)
