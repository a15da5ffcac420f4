"""Risk rule and minute roll-up of enriched hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.spatial_joins import NO_DISTANCE, NO_ID

HIGH, MEDIUM, LOW = "ALTO", "MEDIO", "BAIXO"
NO_LINE, NO_LAND = "N/A", "Nenhuma"

FACT_KEYS = (
    "municipio", "estado", "bioma", "satelite", "risco_eletrico", "em_terra_indigena", "nome_ti", "linha_afetada",
)


def electric_risk(distance_km: Column, high_km: float = 1.0, medium_km: float = 5.0) -> Column:
    """Risk level from the distance to the nearest power line; an unknown distance is low risk."""
    return (
        F.when(distance_km == NO_DISTANCE, LOW)
        .when(distance_km <= high_km, HIGH)
        .when(distance_km <= medium_km, MEDIUM)
        .otherwise(LOW)
    )


def known_distance(distance_km: Column) -> Column:
    """Null instead of the sentinel, so that a minimum never reports -1 km."""
    return F.nullif(distance_km, F.lit(NO_DISTANCE))


def indigenous_flag(land_id: Column) -> Column:
    return F.when(land_id == NO_ID, "false").otherwise("true")


def rollup_measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_focos"),
        F.max("potencia_radiativa_fogo").alias("frp_maximo"),
        F.min(known_distance(F.col("distancia_linha_km"))).alias("dist_linha_minima_km"),
        F.min(known_distance(F.col("distancia_subestacao_km"))).alias("dist_subestacao_minima_km"),
    ]


def minute_rollup(hotspots: DataFrame, time: str = "momento") -> DataFrame:
    """One row per minute and fact key. The aggregation is combined before its single shuffle."""
    return (
        hotspots.groupBy(F.date_trunc("minute", F.col(time)).alias("__time"), *FACT_KEYS)
        .agg(*rollup_measures())
    )
