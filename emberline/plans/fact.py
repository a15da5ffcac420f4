"""The fact table: enriched hotspots, named and rolled up by minute, stored per year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.lookups import name_lookup
from emberline.operators.rollup import NO_LAND, NO_LINE, electric_risk, indigenous_flag, minute_rollup
from emberline.plans.enrichment import SpatialContext, clean_hotspots, locate

FACT_TABLE = "queimadas_focos_calor"


def named_hotspots(
    located: DataFrame, lands: DataFrame | None, lines: DataFrame | None, high_km: float = 1.0, medium_km: float = 5.0
) -> DataFrame:
    """Located hotspots with the text columns of the fact.

    ``bioma`` keeps the label of the source (with accents), which is what the queries filter on.
    """
    named = located.withColumns(
        {
            "municipio": F.col("municipio_norm"),
            "estado": F.col("estado_norm"),
            "bioma": F.col("bioma_rotulo"),
            "satelite": F.col("satelite_sensor"),
            "risco_eletrico": electric_risk(F.col("distancia_linha_km"), high_km, medium_km),
            "em_terra_indigena": indigenous_flag(F.col("codigo_ti")),
        }
    )
    if lands is None:
        named = named.withColumn("nome_ti", F.lit(NO_LAND))
    else:
        named = name_lookup(named, "codigo_ti", lands, "codigo_ti", "nome_terra_indigena", "nome_ti", NO_LAND)
    if lines is None:
        return named.withColumn("linha_afetada", F.lit(NO_LINE))
    return name_lookup(
        named, "id_linha_transmissao", lines, "id_linha_transmissao", "nome_linha", "linha_afetada", NO_LINE
    )


def build_fact(
    raw: DataFrame,
    context: SpatialContext,
    lands: DataFrame | None,
    lines: DataFrame | None,
    high_km: float = 1.0,
    medium_km: float = 5.0,
) -> DataFrame:
    """Raw hotspots to fact rows."""
    located = locate(clean_hotspots(raw), context)
    return minute_rollup(named_hotspots(located, lands, lines, high_km, medium_km))
