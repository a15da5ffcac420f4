"""Road, power-grid and hospital dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.columns import drop_missing, fill_defaults, tolerant_select
from emberline.functions.geometry import first_vertex, wkt_from_parts
from emberline.functions.numbers import number_or_zero, parse_decimal_comma, to_number
from emberline.functions.text import (
    INFRASTRUCTURE,
    NOT_INFORMED,
    TERRITORY,
    html_field,
    normalize_text,
    state_suffix,
    without_unit,
)
from emberline.operators.ids import surrogate_id
from emberline.operators.joins import sized_left_join

# Both naming schemes of the road sources.
ROAD_COLUMNS = {
    "sigla": "codigo_rodovia", "vl_br": "codigo_rodovia",
    "jurisdicao": "jurisdicao", "ds_jurisdi": "jurisdicao",
    "revestimen": "revestimento", "ds_revesti": "revestimento",
    "tipopavime": "tipo_pavimento", "ds_tipo_pa": "tipo_pavimento",
    "situacaofi": "situacao_fisica", "ds_situaca": "situacao_fisica",
    "operaciona": "status_operacional", "ds_operaci": "status_operacional",
}
ROAD_FIELDS = ("codigo_rodovia", "jurisdicao", "revestimento", "tipo_pavimento", "situacao_fisica", "status_operacional")

# Columns of the health registry, and what stands for a missing cell.
HOSPITAL_COLUMNS = (
    "CO_CNES", "NO_FANTASIA", "CO_MUNICIPIO_GESTOR", "TP_UNIDADE", "TP_ESTAB_SEMPRE_ABERTO", "NU_LATITUDE",
    "NU_LONGITUDE",
)
HOSPITAL_DEFAULTS = {
    "NO_FANTASIA": "NÃO INFORMADO",
    "TP_ESTAB_SEMPRE_ABERTO": "N",
    "DS_TIPO_UNIDADE": "TIPO NÃO INFORMADO",
    "NO_MUNICIPIO": "DESCONHECIDO",
    "CO_SIGLA_ESTADO": "NI",
}


def roads(features: DataFrame) -> DataFrame:
    """``dim_rodovias_federais``. The source ``ID`` is kept where the features have one, else ids are numbered in
    the order of the columns. Of a field that stands under the names of both schemes the first is used."""
    known: dict[str, str] = {}
    for name, field in ROAD_COLUMNS.items():
        if name in features.columns and field not in known.values():
            known[name] = field
    features = features.drop(*[n for n in ROAD_COLUMNS if n not in known])
    shaped = features.withColumn("geometria_wkt", wkt_from_parts(F.col("geometry_type"), F.col("parts"), None))
    found = tolerant_select(shaped, ["ID", *ROAD_COLUMNS, "geometria_wkt"], ROAD_COLUMNS)
    clean = found.withColumns(
        {c: normalize_text(F.col(c), INFRASTRUCTURE) for c in ROAD_FIELDS if c in found.columns}
    ).filter(F.col("geometria_wkt").isNotNull())
    if "ID" in clean.columns:
        numbered = clean.withColumn("id_trecho_rodoviario", to_number(F.col("ID")).try_cast("bigint")).drop("ID")
    else:
        numbered = surrogate_id(clean, clean.columns, "id_trecho_rodoviario")
    return tolerant_select(numbered, ["id_trecho_rodoviario", *ROAD_FIELDS, "geometria_wkt"])


def transmission_lines(features: DataFrame) -> DataFrame:
    """``dim_ons_linhas_transmissao``: voltage and length are read from the popup text."""
    popup = F.col("PopupInfo")
    lines = features.select(
        normalize_text(F.col("Name"), INFRASTRUCTURE).alias("nome_linha"),
        number_or_zero(to_number(without_unit(html_field(popup, "Tensão", "0"), " Kv"))).alias("tensao_kv"),
        number_or_zero(
            parse_decimal_comma(without_unit(html_field(popup, "Extensão", "0"), " Km"))
        ).alias("extensao_km"),
        *([to_number(F.col("Shape_Length")).alias("Shape_Length")] if "Shape_Length" in features.columns else []),
        wkt_from_parts(F.col("geometry_type"), F.col("parts")).alias("geometria_wkt"),
    )
    numbered = surrogate_id(lines, lines.columns, "id_linha_transmissao")
    return numbered.select("id_linha_transmissao", *lines.columns)


def substations(features: DataFrame) -> DataFrame:
    """``dim_ons_subestacoes``: capacity and agent are read from the popup text."""
    popup = F.col("PopupInfo")
    vertex = first_vertex(F.col("parts"))
    stations = features.select(
        normalize_text(F.col("Name"), INFRASTRUCTURE).alias("nome_subestacao"),
        number_or_zero(
            parse_decimal_comma(without_unit(html_field(popup, "Capacidade", "0"), " MW"))
        ).alias("capacidade_mw"),
        normalize_text(html_field(popup, "Agente", NOT_INFORMED), INFRASTRUCTURE).alias("agente_responsavel"),
        vertex["y"].alias("latitude"),
        vertex["x"].alias("longitude"),
    )
    numbered = surrogate_id(stations, stations.columns, "id_subestacao")
    return numbered.select("id_subestacao", *stations.columns)


def isolated_systems(features: DataFrame) -> DataFrame:
    """``dim_ons_sistemas_isolados``: the state is the suffix of the popup text."""
    vertex = first_vertex(F.col("parts"))
    systems = features.select(
        normalize_text(F.col("Name"), TERRITORY).alias("nome_sistema_isolado"),
        state_suffix(F.col("PopupInfo")).alias("estado_sigla"),
        F.round(vertex["y"], 6).alias("latitude"),
        F.round(vertex["x"], 6).alias("longitude"),
        wkt_from_parts(F.col("geometry_type"), F.col("parts")).alias("geometria_wkt"),
    )
    numbered = surrogate_id(systems, systems.columns, "id_sistema_isolado")
    return numbered.select("id_sistema_isolado", *systems.columns)


def hospitals(facilities: DataFrame, municipalities: DataFrame, unit_types: DataFrame) -> DataFrame:
    """``dim_hospitais_cnes``: facilities with coordinates, municipality and unit type by code, defaults filled."""
    located = tolerant_select(facilities, HOSPITAL_COLUMNS).withColumns(
        {c: parse_decimal_comma(F.col(c)) for c in ("NU_LATITUDE", "NU_LONGITUDE")}
    )
    located = drop_missing(located, ["NU_LATITUDE", "NU_LONGITUDE"])
    cities = municipalities.select(
        F.col("CO_MUNICIPIO").alias("CO_MUNICIPIO_GESTOR"), "NO_MUNICIPIO", "CO_SIGLA_ESTADO"
    )
    types = unit_types.select(F.col("CO_TIPO_UNIDADE").alias("TP_UNIDADE"), "DS_TIPO_UNIDADE")
    joined = sized_left_join(located, cities, ["CO_MUNICIPIO_GESTOR"], row_bytes=256)
    joined = sized_left_join(joined, types, ["TP_UNIDADE"], row_bytes=256)
    filled = fill_defaults(joined, HOSPITAL_DEFAULTS)
    return filled.select(
        F.col("CO_CNES").alias("codigo_cnes"),
        F.col("NO_FANTASIA").alias("nome_hospital"),
        F.col("DS_TIPO_UNIDADE").alias("tipo_unidade"),
        F.col("TP_ESTAB_SEMPRE_ABERTO").alias("funciona_24h"),
        F.col("CO_MUNICIPIO_GESTOR").alias("codigo_ibge_municipio"),
        F.col("NO_MUNICIPIO").alias("municipios_nome"),
        F.col("CO_SIGLA_ESTADO").alias("estado_sigla"),
        F.col("NU_LATITUDE").alias("latitude"),
        F.col("NU_LONGITUDE").alias("longitude"),
    )
