"""Declared schemas: raw hotspots, dimensions, enriched hotspots, fact and metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TYPES = {"L": T.LongType(), "D": T.DoubleType(), "S": T.StringType(), "I": T.IntegerType(), "T": T.TimestampType()}


def struct(spec: str) -> T.StructType:
    """Schema from ``name:letter`` pairs (L bigint, D double, S string, I int, T timestamp)."""
    fields = (item.split(":") for item in spec.split())
    return T.StructType([T.StructField(name, _TYPES[letter]) for name, letter in fields])


@dataclass(frozen=True)
class DimensionSpec:
    """A dimension table: typed columns and the constant time stamped on every row."""

    name: str
    schema: T.StructType
    time: str = "2025-01-01 00:00:00"


_DIMENSION_COLUMNS = {
    "dim_municipios_coordenadas": "codigo_ibge:L chave_localidade:S estado_nome:S municipios_nome:S "
    "lat_centroide:D lon_centroide:D geometria_wkt:S",
    "dim_terras_indigenas_funai": "codigo_ti:L nome_terra_indigena:S etnia:S municipios:S estado:S area_hectares:D "
    "estagio_regularizacao:S modalidade:S em_faixa_fronteira:S geometria_wkt:S",
    "dim_mapbiomas_municipios": "chave_localidade:S municipio_norm:S estado_norm:S bioma_norm:S id_classe_solo:L "
    "categoria_macro:S uso_cobertura_solo:S area_hectares:D",
    "dim_mapbiomas_terras_indigenas": "nome_ti_limpo:S estado_norm:S bioma_norm:S id_classe_solo:L categoria_macro:S "
    "uso_cobertura_solo:S area_hectares:D",
    "dim_mapbiomas_quilombos": "nome_quilombo_limpo:S estado_norm:S bioma_norm:S id_classe_solo:L categoria_macro:S "
    "uso_cobertura_solo:S area_hectares:D",
    "dim_mapbiomas_unidades_conservacao": "nome_uc_limpo:S esfera_governamental:S tipo_uso:S categoria_uc:S "
    "estado_norm:S bioma_norm:S id_classe_solo:L categoria_macro:S uso_cobertura_solo:S area_hectares:D",
    "dim_rodovias_federais": "id_trecho_rodoviario:L codigo_rodovia:S jurisdicao:S revestimento:S tipo_pavimento:S "
    "situacao_fisica:S status_operacional:S geometria_wkt:S",
    "dim_ons_linhas_transmissao": "id_linha_transmissao:L nome_linha:S tensao_kv:D extensao_km:D Shape_Length:D "
    "geometria_wkt:S",
    "dim_ons_subestacoes": "id_subestacao:L nome_subestacao:S capacidade_mw:D agente_responsavel:S latitude:D "
    "longitude:D",
    "dim_ons_sistemas_isolados": "id_sistema_isolado:L nome_sistema_isolado:S estado_sigla:S latitude:D longitude:D "
    "geometria_wkt:S",
    "dim_hospitais_cnes": "codigo_cnes:L nome_hospital:S tipo_unidade:S funciona_24h:S codigo_ibge_municipio:L "
    "municipios_nome:S estado_sigla:S latitude:D longitude:D",
}

DIMENSIONS = {
    name: DimensionSpec(
        name, struct(columns), "2010-01-01 00:00:00" if name == "dim_ons_subestacoes" else "2025-01-01 00:00:00"
    )
    for name, columns in _DIMENSION_COLUMNS.items()
}

RAW_HOTSPOT = struct(
    "DataHora:S Estado:S Municipio:S Latitude:D Longitude:D Bioma:S Satelite:S DiaSemChuva:D Precipitacao:D "
    "RiscoFogo:D FRP:D"
)

ENRICHED_HOTSPOT = struct(
    "id_data:I data_hora:S chave_localidade:S codigo_ti:L codigo_ibge_espacial:L id_trecho_rodoviario:L "
    "distancia_rodovia_km:D id_linha_transmissao:L distancia_linha_km:D id_subestacao:L distancia_subestacao_km:D "
    "id_sistema_isolado:L distancia_sistema_isolado_km:D codigo_cnes_prox:L distancia_hospital_km:D latitude:D "
    "longitude:D bioma_inpe:S satelite_sensor:S dias_sem_chuva:D precipitacao_mm:D risco_fogo_inpe:D "
    "potencia_radiativa_fogo:D"
)

FACT = struct(
    "__time:T municipio:S estado:S bioma:S satelite:S risco_eletrico:S em_terra_indigena:S nome_ti:S linha_afetada:S "
    "total_focos:L frp_maximo:D dist_linha_minima_km:D dist_subestacao_minima_km:D"
)

SYSTEM_METRICS = struct("__time:T metric_name:S unit:S value:D")
