"""Batch readers. Tables are read as text by header name and typed afterwards, so bad cells become null."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions.geometry import parts_from_geojson
from emberline.session import materialize
from emberline.sources.ranges import geojson_features, split_csv


def read_csv(
    spark: SparkSession, path: str, *, schema: T.StructType | None = None, sep: str = ",", encoding: str = "UTF-8",
    glob: str | None = None, multiline: bool = False,
) -> DataFrame:
    """Delimited text with a header. Without ``schema`` every column is text, which keeps leading zeros.

    With one, its columns are picked by the header's names, in whatever order and among whatever others they stand;
    a bad cell or an absent column is null. Files whose headers differ from each other are refused. ``multiline`` is for sources
    with line ends in quoted cells; such files are read by byte ranges too (``split_csv`` has its rules).
    """
    if multiline:
        text = split_csv(spark, path, sep, encoding, glob)
        return text if schema is None else pick_columns(text, schema)
    reader = spark.read.options(
        header=True, sep=sep, encoding=encoding, quote='"', escape='"', mode="PERMISSIVE", enforceSchema=False
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    text = reader.csv(path)
    return text if schema is None else pick_columns(text, schema)


def pick_columns(text: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` by name, typed; null where a cell cannot be read or the column is absent."""
    return text.select(*[
        (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in text.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def read_facility_csv(spark: SparkSession, path: str) -> DataFrame:
    """Health-registry export: semicolons, Latin-1, all columns as text."""
    return read_csv(spark, path, sep=";", encoding="ISO-8859-1")


def read_sheet(spark: SparkSession, path: str, *, skip_rows: int = 0) -> DataFrame:
    """A sheet exported as CSV, all columns as text, with ``skip_rows`` title rows above the header.

    Title rows are told apart by their position in the file: the first split of the file holds the head. With title rows
    ``path`` must therefore be a single file.
    """
    if not skip_rows:
        return read_csv(spark, path)
    if len(spark.read.text(path).inputFiles()) != 1:
        raise ValueError(f"title rows can be skipped in a single file only: {path}")
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row")
    )
    # the title rows and the header only
    head = lines.filter(F.col("_start") == 0).orderBy("_row").limit(skip_rows + 1).collect()
    names = next(csv.reader([head[-1]["value"]]))
    schema = ", ".join(f"`{n}` string" for n in names)
    cells = F.from_csv("value", schema, {"quote": '"', "escape": '"'})
    body = lines.filter((F.col("_row") > head[-1]["_row"]) & (F.length("value") > 0))
    return body.select(cells.alias("c")).select("c.*")


def _feature_type(properties: Sequence[str]) -> T.StructType:
    text = T.StringType()
    return T.StructType([
        T.StructField("id", text),
        T.StructField("properties", T.StructType([T.StructField(p, text) for p in properties])),
        # raw JSON text, because the nesting depends on the geometry type
        T.StructField("geometry", T.StructType([T.StructField("type", text), T.StructField("coordinates", text)])),
    ])


def _feature_columns(features: DataFrame, properties: Sequence[str]) -> DataFrame:
    """``feature_id``, the ``properties`` as text columns, ``geometry_type`` and ``parts``."""
    kind, coordinates = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    return features.select(
        F.col("f.id").alias("feature_id"),
        *[F.col("f.properties").getField(p).alias(p) for p in properties],
        F.upper(kind).alias("geometry_type"),
        parts_from_geojson(kind, coordinates).alias("parts"),
    )


def read_geojson(spark: SparkSession, path: str, properties: Sequence[str]) -> DataFrame:
    """FeatureCollection documents, one row per feature.

    A document is parsed by one task, so this suits paged files; ``read_large_geojson`` reads one of any size by many tasks.
    """
    document = T.StructType([T.StructField("features", T.ArrayType(_feature_type(properties)))])
    documents = spark.read.schema(document).option("multiLine", True).json(path)
    return _feature_columns(documents.select(F.explode("features").alias("f")), properties)


def read_large_geojson(spark: SparkSession, path: str, properties: Sequence[str]) -> DataFrame:
    """The same rows as ``read_geojson``, from documents that are cut into byte ranges; a range needs no more memory than its features.

    The files must be plain text (a compressed file is one range) and hold a collection each. Of a document that
    breaks off, the features before the break are read.
    """
    features = geojson_features(spark, path).select(F.from_json("value", _feature_type(properties)).alias("f"))
    return _feature_columns(features, properties)


def read_geojson_lines(spark: SparkSession, path: str, properties: Sequence[str]) -> DataFrame:
    """Features stored one per line (with or without an enclosing collection); splits like any text file."""
    line = F.regexp_replace(F.trim("value"), ",$", "")
    lines = spark.read.text(path).select(line.alias("value")).filter(
        F.col("value").rlike(r'^\{.*"type"\s*:\s*"Feature"\s*[,}]')
    )
    features = lines.select(F.from_json("value", _feature_type(properties)).alias("f"))
    return _feature_columns(features, properties)


def merge_geojson_pages(
    spark: SparkSession, path: str, properties: Sequence[str], page_size: int = 1000, page_pattern: str = r"page[=_-]?(\d+)"
) -> DataFrame:
    """Features of numbered page files up to and including the first page that is short, empty or not followed.

    The first group of ``page_pattern`` finds the page number in the path of a file.
    """
    document = T.StructType([T.StructField("features", T.ArrayType(_feature_type(properties)))])
    pages = spark.read.schema(document).option("multiLine", True).json(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), page_pattern, 1).cast("bigint").alias("page"),
        F.coalesce("features", F.array().cast(T.ArrayType(_feature_type(properties)))).alias("features"),
    )
    # parsed once: first to find the last page, then for the features
    pages = materialize(pages, "geojson-pages")
    sizes = pages.select("page", F.size("features").alias("n"))
    following = sizes.select((F.col("page") - 1).alias("page"), F.lit(True).alias("followed"))
    last = (
        sizes.join(following, "page", "left")
        .filter((F.col("n") < page_size) | F.col("followed").isNull())
        .agg(F.min("page"))
        .first()[0]
    )
    kept = pages.filter(F.col("page") <= F.lit(last))
    return _feature_columns(kept.select(F.explode("features").alias("f")), properties)
