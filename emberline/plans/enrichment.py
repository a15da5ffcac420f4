"""Hotspot cleaning and spatial enrichment, the same for batch and streaming frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.columns import locality_key
from emberline.functions.numbers import clean_metric, to_number
from emberline.functions.projections import polyconic_xy
from emberline.functions.text import normalize_text, strip
from emberline.functions.timebuckets import date_key, parse_timestamp, timestamp_text
from emberline.operators.spatial_index import (
    CellIndex,
    containment_index,
    layer_shapes,
    metric_segments,
    nearest_index,
    polygon_edges,
)
from emberline.operators.spatial_joins import nearest, within
from emberline.schemas import ENRICHED_HOTSPOT

# layer -> (id column of the dimension, output id[, output distance])
AREA_LAYERS = {
    "terras": ("codigo_ti", "codigo_ti"),
    "municipios": ("codigo_ibge", "codigo_ibge_espacial"),
}
DISTANCE_LAYERS = {
    "rodovias": ("id_trecho_rodoviario", "id_trecho_rodoviario", "distancia_rodovia_km"),
    "linhas": ("id_linha_transmissao", "id_linha_transmissao", "distancia_linha_km"),
    "subestacoes": ("id_subestacao", "id_subestacao", "distancia_subestacao_km"),
    "sistemas": ("id_sistema_isolado", "id_sistema_isolado", "distancia_sistema_isolado_km"),
    "hospitais": ("codigo_cnes", "codigo_cnes_prox", "distancia_hospital_km"),
}

_NUMERIC = ("double", "float", "int", "bigint")


@dataclass(frozen=True)
class SpatialContext:
    """The cell indexes of the layers; built once and reused by every run."""

    areas: Sequence[CellIndex]
    distances: Sequence[CellIndex]


def build_context(layers: Mapping[str, DataFrame | None], **options) -> SpatialContext:
    """Index the dimension layers.

    ``layers`` maps the names of ``AREA_LAYERS`` and ``DISTANCE_LAYERS`` to dimension tables; a missing one yields
    sentinels. The indexes answer for every position, so one context serves all batches and streams.
    """
    areas = layer_shapes({n: (layers.get(n), key) for n, (key, _) in AREA_LAYERS.items()})
    infrastructure = layer_shapes({n: (layers.get(n), key) for n, (key, *_) in DISTANCE_LAYERS.items()})
    inside = containment_index(polygon_edges(areas)) if areas is not None else []
    distances = nearest_index(metric_segments(infrastructure), **options) if infrastructure is not None else []
    return SpatialContext(inside, distances)


def clean_hotspots(raw: DataFrame) -> DataFrame:
    """Typed and cleaned hotspot columns; every input column is kept.

    A missing coordinate column counts as 0.0; an empty or unreadable cell becomes NaN (it gets the spatial sentinels).
    """
    absent = [c for c in ("Latitude", "Longitude") if c not in raw.columns]
    raw = raw.withColumns({c: F.lit(0.0) for c in absent}) if absent else raw
    types = dict(raw.dtypes)

    def metric(name: str):
        return clean_metric(F.col(name), numeric=types[name] in _NUMERIC).cast("double")

    def coordinate(name: str):
        number = F.col(name).cast("double") if types[name] in _NUMERIC else to_number(F.col(name))
        return F.coalesce(number, F.lit(float("nan")))

    time = F.col("DataHora") if types["DataHora"].startswith("timestamp") else parse_timestamp(F.col("DataHora"))
    label = strip(F.col("Bioma"))
    return (
        raw.withColumn("_ts", time.cast("timestamp"))
        .withColumns(
            {
                "id_data": date_key(F.col("_ts")),
                "data_hora_texto": timestamp_text(F.col("_ts")),
                "momento": F.coalesce(F.col("_ts"), F.timestamp_seconds(F.lit(0))),
                "estado_norm": normalize_text(F.col("Estado")),
                "municipio_norm": normalize_text(F.col("Municipio")),
                "latitude": coordinate("Latitude"),
                "longitude": coordinate("Longitude"),
                "bioma_inpe": normalize_text(F.col("Bioma")),
                "bioma_rotulo": F.when(label != "", label).otherwise("NAO INFORMADO"),
                "satelite_sensor": normalize_text(F.col("Satelite")),
                "dias_sem_chuva": metric("DiaSemChuva"),
                "precipitacao_mm": metric("Precipitacao"),
                "risco_fogo_inpe": metric("RiscoFogo"),
                "potencia_radiativa_fogo": metric("FRP"),
            }
        )
        .withColumn("chave_localidade", locality_key(F.col("estado_norm"), F.col("municipio_norm")))
        .drop("_ts")
    )


def locate(points: DataFrame, context: SpatialContext, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Add all territory ids and nearest infrastructure to ``points``: one row out per row in."""
    x, y = polyconic_xy(F.col(lon), F.col(lat))
    valid = ~F.isnan(lon) & ~F.isnan(lat)
    positions = {"_lon": F.col(lon), "_lat": F.col(lat), "_x": x, "_y": y}
    located = points.withColumns({name: F.when(valid, c) for name, c in positions.items()})
    located = within(located, context.areas, "_lon", "_lat", {n: out for n, (_, out) in AREA_LAYERS.items()})
    located = nearest(
        located, context.distances, "_x", "_y", {n: (i, km) for n, (_, i, km) in DISTANCE_LAYERS.items()}
    )
    return located.drop("_x", "_y", "_lon", "_lat")


def enriched_record(located: DataFrame, *extra: str) -> DataFrame:
    """The published record of a located hotspot, in schema order, plus ``extra`` columns."""
    fields = [
        F.col("data_hora_texto").alias("data_hora") if f.name == "data_hora" else F.col(f.name)
        for f in ENRICHED_HOTSPOT.fields
    ]
    return located.select(*fields, *extra)


def enrich_hotspots(raw: DataFrame, context: SpatialContext, *extra: str) -> DataFrame:
    """Raw hotspots to enriched records."""
    return enriched_record(locate(clean_hotspots(raw), context), *extra)
