"""Scalar functions: text, numbers, keys and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from emberline.functions.columns import locality_key, macro_category, state_name
from emberline.functions.numbers import clean_metric, number_or_zero, parse_decimal_comma, to_number
from emberline.functions.text import (
    HOTSPOT,
    INFRASTRUCTURE,
    LAND_COVER,
    html_field,
    normalize_text,
    state_suffix,
    strip_code,
    without_unit,
)
from emberline.functions.timebuckets import date_key, parse_timestamp, timestamp_text
from fixtures import fixture, oracle

# all the white space a cleaned text may start or end with, as a DuckDB trim set
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def _clean(c: str, fold: bool) -> str:
    text = f"replace(replace({c}, chr(10), ' '), chr(13), ' ')" if fold else c
    return f"strip_accents(upper(replace(trim({text}, {_BLANKS}), 'ß', 'SS')))"


@query("normalize_text", oracle(f"""
SELECT doc_id, CASE WHEN text IS NULL OR trim(text, {_BLANKS}) = '' THEN 'NAO INFORMADO' ELSE {_clean('text', True)} END AS hotspot,
  coalesce({_clean('text', False)}, '') AS cobertura,
  coalesce({_clean('text', False)}, 'NAO INFORMADO') AS infraestrutura
FROM documents"""))
def _(spark, sf):
    text = F.col("text")
    return fixture(spark, sf, "SELECT doc_id, text FROM documents").select(
        "doc_id",
        normalize_text(text, HOTSPOT).alias("hotspot"),
        normalize_text(text, LAND_COVER).alias("cobertura"),
        normalize_text(text, INFRASTRUCTURE).alias("infraestrutura"),
    )


@query("strip_code", oracle(f"""
SELECT doc_id, coalesce({_clean("split_part(text, '(', 1)", False)}, '') AS nome FROM documents
UNION ALL SELECT -1 - terr, coalesce({_clean("split_part(coded_name, '(', 1)", False)}, '') FROM cover_named"""))
def _(spark, sf):
    names = fixture(
        spark, sf, "SELECT doc_id, text AS name FROM documents UNION ALL SELECT -1 - terr, coded_name FROM cover_named"
    )
    return names.select("doc_id", strip_code(F.col("name")).alias("nome"))


_DIRTY = """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'abc' WHEN event_id % 11 = 0 THEN 'Infinity' WHEN event_id % 13 = 0 THEN 'NaN'
  WHEN event_id % 17 = 0 THEN '-999.0' WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 23 = 0 THEN '-1000'
  ELSE CAST(event_id % 5000 AS STRING) || '.25' END AS texto FROM events"""


@query("clean_metric", oracle(f"""
SELECT event_id, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) OR v <= -900 THEN 0e0 ELSE v END AS com_piso,
  CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0e0 ELSE v END AS sem_piso
FROM (SELECT event_id, try_cast(texto AS DOUBLE) AS v FROM ({_DIRTY}))"""))
def _(spark, sf):
    text = F.col("texto")
    return fixture(spark, sf, _DIRTY).select(
        "event_id", clean_metric(text).alias("com_piso"), clean_metric(text, None).alias("sem_piso")
    )


@query("parse_decimal_comma", oracle("""
SELECT CO_CNES, try_cast(replace(NU_LATITUDE, ',', '.') AS DOUBLE) AS latitude,
  coalesce(try_cast(replace(NU_LONGITUDE, ',', '.') AS DOUBLE), 0e0) AS longitude_ou_zero
FROM facilities"""))
def _(spark, sf):
    return fixture(spark, sf, "facilities").select(
        "CO_CNES",
        parse_decimal_comma(F.col("NU_LATITUDE")).alias("latitude"),
        number_or_zero(parse_decimal_comma(F.col("NU_LONGITUDE"))).alias("longitude_ou_zero"),
    )


def _field(column: str, label: str) -> str:
    return f"regexp_extract({column}, '<b>{label}:\\s*</b>(.*?)(?:<br/>|$)', 1, 'i')"


_POPUP_ORACLE = f"""
SELECT s_suppkey, coalesce(try_cast(nullif(trim(replace({_field('line_popup', 'Tensão')}, ' Kv', '')), '') AS DOUBLE), 0e0) AS tensao_kv,
  coalesce(try_cast(replace(trim(replace({_field('line_popup', 'Extensão')}, ' Km', '')), ',', '.') AS DOUBLE), 0e0) AS extensao_km,
  coalesce(try_cast(replace(trim(replace({_field('station_popup', 'Capacidade')}, ' MW', '')), ',', '.') AS DOUBLE), 0e0)
    AS capacidade_mw,
  strip_accents(upper(trim({_field('station_popup', 'Agente')}))) AS agente
FROM popups"""


@query("html_field", oracle(_POPUP_ORACLE))
def _(spark, sf):
    line, station = F.col("line_popup"), F.col("station_popup")
    return fixture(spark, sf, "popups").select(
        "s_suppkey",
        number_or_zero(to_number(without_unit(html_field(line, "Tensão", "0"), " Kv"))).alias("tensao_kv"),
        number_or_zero(parse_decimal_comma(without_unit(html_field(line, "Extensão", "0"), " Km"))).alias("extensao_km"),
        number_or_zero(
            parse_decimal_comma(without_unit(html_field(station, "Capacidade", "0"), " MW"))
        ).alias("capacidade_mw"),
        normalize_text(html_field(station, "Agente", "NAO INFORMADO"), INFRASTRUCTURE).alias("agente"),
    )


@query("state_suffix", oracle("""
SELECT s_suppkey, CASE WHEN contains(system_popup, '-') THEN upper(trim(split_part(system_popup, '-', -1))) ELSE 'NA' END AS uf
FROM popups"""))
def _(spark, sf):
    return fixture(spark, sf, "popups").select("s_suppkey", state_suffix(F.col("system_popup")).alias("uf"))


_CODES = "SELECT c_custkey, CAST(10 + c_custkey % 50 AS STRING) || lpad(CAST(c_custkey AS STRING), 5, '0') AS codigo FROM customer"
# The state table again, written out for the check.
_STATES = """CASE substr(codigo, 1, 2) WHEN '11' THEN 'RONDONIA' WHEN '12' THEN 'ACRE' WHEN '13' THEN 'AMAZONAS'
  WHEN '14' THEN 'RORAIMA' WHEN '15' THEN 'PARA' WHEN '16' THEN 'AMAPA' WHEN '17' THEN 'TOCANTINS'
  WHEN '21' THEN 'MARANHAO' WHEN '22' THEN 'PIAUI' WHEN '23' THEN 'CEARA' WHEN '24' THEN 'RIO GRANDE DO NORTE'
  WHEN '25' THEN 'PARAIBA' WHEN '26' THEN 'PERNAMBUCO' WHEN '27' THEN 'ALAGOAS' WHEN '28' THEN 'SERGIPE'
  WHEN '29' THEN 'BAHIA' WHEN '31' THEN 'MINAS GERAIS' WHEN '32' THEN 'ESPIRITO SANTO' WHEN '33' THEN 'RIO DE JANEIRO'
  WHEN '35' THEN 'SAO PAULO' WHEN '41' THEN 'PARANA' WHEN '42' THEN 'SANTA CATARINA' WHEN '43' THEN 'RIO GRANDE DO SUL'
  WHEN '50' THEN 'MATO GROSSO DO SUL' WHEN '51' THEN 'MATO GROSSO' WHEN '52' THEN 'GOIAS' WHEN '53' THEN 'DISTRITO FEDERAL'
  END"""


@query("state_lookup", f"SELECT c_custkey, codigo, {_STATES} AS estado_nome FROM ({_CODES})")
def _(spark, sf):
    return fixture(spark, sf, _CODES).select("c_custkey", "codigo", state_name(F.col("codigo")).alias("estado_nome"))


@query("locality_key", oracle(f"""
SELECT event_id, estado || '_' || municipio AS chave_foco, {_STATES} || '_' || municipio AS chave_dimensao
FROM (SELECT *, CAST(10 + event_id % 50 AS STRING) AS codigo FROM clean)"""))
def _(spark, sf):
    raw = fixture(spark, sf, "hotspots")
    city = normalize_text(F.col("Municipio"))
    return raw.select(
        "event_id",
        locality_key(normalize_text(F.col("Estado")), city).alias("chave_foco"),
        locality_key(state_name((10 + F.col("event_id") % 50).cast("string")), city).alias("chave_dimensao"),
    )


@query("date_key", oracle("SELECT event_id, id_data, data_hora FROM clean"))
def _(spark, sf):
    ts = parse_timestamp(F.col("DataHora"))
    return fixture(spark, sf, "hotspots").select(
        "event_id", date_key(ts).alias("id_data"), timestamp_text(ts).alias("data_hora")
    )


_LABELS = """
SELECT p_partkey, CASE WHEN p_partkey % 8 = 7 THEN NULL ELSE CAST(p_partkey % 8 AS STRING) || '. ' || p_name END AS classe
FROM part"""


@query("macro_category", f"""
SELECT p_partkey, CASE substr(classe, 1, 2) WHEN '1.' THEN '1. Floresta' WHEN '2.' THEN '2. Vegetação Não Florestal'
  WHEN '3.' THEN '3. Agropecuária' WHEN '4.' THEN '4. Área não Vegetada' WHEN '5.' THEN '5. Corpo D''água' ELSE 'Outros' END AS macro
FROM ({_LABELS})""")
def _(spark, sf):
    return fixture(spark, sf, _LABELS).select("p_partkey", macro_category(F.col("classe")).alias("macro"))
