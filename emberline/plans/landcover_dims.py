"""Land-cover dimensions: one job, four territory kinds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.columns import fill_defaults, locality_key
from emberline.functions.text import LAND_COVER, NOT_INFORMED, normalize_text, strip_code
from emberline.operators.landcover import clean_legend, latest_cover
from emberline.operators.lookups import legend_join

LEGEND_CODE, LEGEND_LABEL = "Code ID", "COLEÇÃO 10 - CLASSES"


@dataclass(frozen=True)
class LandCoverKind:
    """Where a territory kind keeps its name and class, and which attributes it adds."""

    dimension: str
    territory: str
    name: str
    class_column: str = "class_id"
    coded_name: bool = True
    attributes: tuple[tuple[str, str], ...] = ()


MUNICIPALITIES = LandCoverKind("dim_mapbiomas_municipios", "municipality", "municipio_norm", coded_name=False)
INDIGENOUS_LANDS = LandCoverKind("dim_mapbiomas_terras_indigenas", "indigenous_territories", "nome_ti_limpo")
QUILOMBOS = LandCoverKind("dim_mapbiomas_quilombos", "quilombo_territory", "nome_quilombo_limpo")
PROTECTED_AREAS = LandCoverKind(
    "dim_mapbiomas_unidades_conservacao",
    "protected_area_name",
    "nome_uc_limpo",
    class_column="class",
    attributes=(
        ("protected_area_political_level", "esfera_governamental"),
        ("protected_area_use_type", "tipo_uso"),
        ("protected_area_type", "categoria_uc"),
    ),
)


def land_cover_dimension(kind: LandCoverKind, wide: DataFrame, legend: DataFrame) -> DataFrame:
    """Newest positive areas of each territory and class, with normalised names and the legend."""
    if kind.territory not in wide.columns:
        raise ValueError(f"column {kind.territory!r} not found")
    keys = [kind.territory, "state", "biome", *[source for source, _ in kind.attributes]]
    area = latest_cover(wide, keys, kind.class_column)
    clean_name = strip_code if kind.coded_name else normalize_text
    named = area.withColumns(
        {
            kind.name: clean_name(F.col(kind.territory), LAND_COVER),
            "estado_norm": normalize_text(F.col("state"), LAND_COVER),
            "bioma_norm": normalize_text(F.col("biome"), LAND_COVER),
        }
    )
    joined = legend_join(named, clean_legend(legend, LEGEND_CODE, LEGEND_LABEL))
    columns = [
        kind.name,
        *[F.col(source).alias(name) for source, name in kind.attributes],
        "estado_norm", "bioma_norm", F.col("class_id").alias("id_classe_solo"),
        "categoria_macro", "uso_cobertura_solo", "area_hectares",
    ]
    if kind is MUNICIPALITIES:
        columns.insert(0, locality_key(F.col("estado_norm"), F.col("municipio_norm")).alias("chave_localidade"))
    out = joined.select(*columns)
    textual = [name for name, type_ in out.dtypes if type_ == "string"]
    return fill_defaults(out, dict.fromkeys(textual, NOT_INFORMED))
