"""Typed load of dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions.numbers import to_number
from emberline.schemas import DIMENSIONS, DimensionSpec
from emberline.sources.readers import read_csv
from emberline.sources.versions import replace_table


def permissive(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """Cast that yields null for a bad cell; integral decimals such as ``'3.0'`` are whole numbers."""
    if source == target:
        return c
    if isinstance(target, T.LongType):
        number = to_number(c) if isinstance(source, T.StringType) else c.cast("double")
        whole = F.when(number == F.floor(number), number.try_cast("bigint"))
        return F.coalesce(c.try_cast("bigint"), whole) if isinstance(source, T.StringType) else whole
    if isinstance(target, T.DoubleType):
        return to_number(c) if isinstance(source, T.StringType) else c.cast("double")
    return c.cast(target)


def typed_dimension(df: DataFrame, spec: DimensionSpec | str) -> DataFrame:
    """``__time`` plus the declared columns in order; a column the input lacks is null."""
    spec = DIMENSIONS[spec] if isinstance(spec, str) else spec
    columns = [F.lit(spec.time).cast("timestamp").alias("__time")]
    for field in spec.schema.fields:
        if field.name in df.columns:
            source = df.schema[field.name].dataType
            columns.append(permissive(F.col(f"`{field.name}`"), source, field.dataType).alias(field.name))
        else:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*columns)


def load_dimension(spark: SparkSession, base_dir: str, name: str, target: str, glob: str | None = None) -> DataFrame:
    """Load the CSV files of a dimension from ``base_dir`` into the table folder ``target`` and return the table.

    The whole table is replaced in one step: ``target`` is a versioned table, so its readers (``versions.read``) see the old rows
    or the new ones, and a load that fails changes nothing.
    """
    typed = typed_dimension(read_csv(spark, base_dir, glob=glob or f"{name}*.csv"), name)
    return replace_table(typed, target)
