"""Municipality and indigenous-land dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.columns import locality_key, state_name, tolerant_select
from emberline.functions.geometry import wkt_from_parts
from emberline.functions.measures import centroid
from emberline.functions.text import MUNICIPALITY, TERRITORY, normalize_text, strip

MUNICIPALITY_PROPERTIES = ("id", "name")

LAND_COLUMNS = {
    "terrai_codigo": "codigo_ti",
    "terrai_nome": "nome_terra_indigena",
    "etnia_nome": "etnia",
    "municipio_nome": "municipios",
    "uf_sigla": "estado",
    "superficie_perimetro_ha": "area_hectares",
    "fase_ti": "estagio_regularizacao",
    "modalidade_ti": "modalidade",
    "faixa_fronteira": "em_faixa_fronteira",
    "the_geom": "geometria_wkt",
}


def municipalities(features: DataFrame) -> DataFrame:
    """``dim_municipios_coordenadas`` from features (``feature_id, id, name, geometry_type, parts``).

    The code is the ``id`` property, or the feature's own id.
    """
    code = strip(F.coalesce("id", "feature_id"))
    named = features.withColumn("codigo_ibge", code).withColumns(
        {
            "estado_nome": state_name(F.col("codigo_ibge")),
            "municipios_nome": normalize_text(F.col("name"), MUNICIPALITY),
            "_centre": centroid(F.col("parts")),
            "geometria_wkt": wkt_from_parts(F.col("geometry_type"), F.col("parts")),
        }
    )
    return named.filter(F.col("codigo_ibge").isNotNull()).select(
        "codigo_ibge",
        locality_key(F.col("estado_nome"), F.col("municipios_nome")).alias("chave_localidade"),
        "estado_nome",
        "municipios_nome",
        F.col("_centre.lat").alias("lat_centroide"),
        F.col("_centre.lon").alias("lon_centroide"),
        "geometria_wkt",
    )


def indigenous_lands(raw: DataFrame) -> DataFrame:
    """``dim_terras_indigenas_funai``: present columns renamed, land name normalised, geometry kept as WKT."""
    lands = tolerant_select(raw, LAND_COLUMNS, LAND_COLUMNS)
    return lands.withColumn("nome_terra_indigena", normalize_text(F.col("nome_terra_indigena"), TERRITORY))
