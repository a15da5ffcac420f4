"""Joins of hotspots and facts with dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.joins import sized_left_join


def name_lookup(
    df: DataFrame, key: str, dimension: DataFrame, dim_key: str, dim_name: str, out: str, default: str
) -> DataFrame:
    """Add ``out``: the dimension's name for ``key``, or ``default`` where the key has no row.

    A repeated dimension key never multiplies rows: the lowest name wins.
    """
    names = dimension.groupBy(F.col(dim_key).cast("bigint").alias(key)).agg(F.min(dim_name).alias(out))
    joined = sized_left_join(df, names, [key], row_bytes=256)
    return joined.withColumn(out, F.coalesce(out, F.lit(default)))


def star_lookup(df: DataFrame, lookups: list[tuple[str, DataFrame, str, str, str, str]]) -> DataFrame:
    """Apply several ``name_lookup`` steps: ``(key, dimension, dim_key, dim_name, out, default)`` each."""
    for key, dimension, dim_key, dim_name, out, default in lookups:
        df = name_lookup(df, key, dimension, dim_key, dim_name, out, default)
    return df


def locality_lookup(df: DataFrame, municipalities: DataFrame, columns: list[str], key: str = "chave_localidade") -> DataFrame:
    """Add ``columns`` of the municipality that state and name in ``key`` spell; null where none does.

    A key that several municipalities share never multiplies rows: the smallest values, in the order of ``columns``, win.
    """
    chosen = municipalities.groupBy(key).agg(F.min(F.struct(*columns)).alias("_municipality"))
    joined = sized_left_join(df, chosen, [key], row_bytes=512)
    return joined.select(*df.columns, *[F.col(f"_municipality.{c}").alias(c) for c in columns])


def legend_join(cover: DataFrame, legend: DataFrame, key: str = "class_id") -> DataFrame:
    """Land cover with its legend, left join. Missing codes match missing codes.

    Codes are compared as numbers and missing is a value of its own, so the join is a plain equi-join. A repeated
    legend code multiplies rows.
    """
    code = F.coalesce(F.col(key).cast("double").cast("string"), F.lit("missing"))
    marked = cover.withColumn("_code", code)
    codes = legend.withColumn("_code", code).drop(key)
    return sized_left_join(marked, codes, ["_code"], row_bytes=512).drop("_code")


def cover_by_territory(territories: DataFrame, cover: DataFrame, name: str, cover_name: str) -> DataFrame:
    """Area per territory and macro category, by normalised name.

    The land cover is summed to one row per name and category before the join.
    """
    areas = cover.groupBy(F.col(cover_name).alias(name), "categoria_macro").agg(
        F.sum("area_hectares").alias("area_hectares")
    )
    joined = sized_left_join(territories, areas.withColumn("_found", F.lit(True)), [name], row_bytes=256)
    return joined.filter("_found").drop("_found")
