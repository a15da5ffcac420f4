"""Land-cover statistics: newest year, classes and macro categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.columns import macro_category, with_latest_year, year_columns
from emberline.functions.numbers import to_number


def latest_cover(wide: DataFrame, keys: list[str], class_column: str = "class_id") -> DataFrame:
    """Positive areas of the newest year; the class code is read as a number, null if unreadable."""
    area = with_latest_year(wide, [*keys, class_column])
    code = to_number(F.col(class_column)).try_cast("bigint")
    area = area.withColumn("area_hectares", F.col("area_hectares").cast("double"))
    return area.withColumn(class_column, code).withColumnRenamed(class_column, "class_id")


def cover_history(wide: DataFrame, keys: list[str]) -> DataFrame:
    """All years as rows: ``keys, ano, area_hectares``."""
    years = year_columns(wide)
    typed = wide.select(*keys, *[F.col(f"`{y}`").cast("double").alias(y) for y in years])
    long = typed.unpivot(keys, years, "ano", "area_hectares")
    return long.withColumn("ano", F.col("ano").cast("int"))


def clean_legend(legend: DataFrame, code: str, label: str) -> DataFrame:
    """Legend as ``class_id, uso_cobertura_solo, categoria_macro``.

    Rows with a missing cell go first; a code that is text but no number then becomes null.
    """
    kept = legend.select(F.col(f"`{code}`").alias("_code"), F.col(f"`{label}`").alias("uso_cobertura_solo")).na.drop("any")
    return kept.select(
        to_number(F.col("_code")).try_cast("bigint").alias("class_id"),
        "uso_cobertura_solo",
        macro_category(F.col("uso_cobertura_solo")).alias("categoria_macro"),
    )
