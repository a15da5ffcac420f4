"""Batch writers: CSV, GeoJSON and JSON events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.geometry import geojson_from_parts, parts_from_wkt, wkt_kind
from emberline.operators.ids import surrogate_id


def write_csv(df: DataFrame, path: str, *, sep: str = ",", encoding: str = "UTF-8") -> None:
    """CSV with a header and ``\\n`` line ends; quotes are doubled. Also the sink for query results."""
    df.write.mode("overwrite").options(
        header=True, sep=sep, encoding=encoding, lineSep="\n", quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def feature_json(df: DataFrame, geometry: Column, *, exclude: Sequence[str] = ()) -> Column:
    """A GeoJSON Feature per row: every column but ``exclude`` is a property, nulls included."""
    names = [c for c in df.columns if c not in exclude]
    properties = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"ignoreNullFields": "false"})
    return F.concat(
        F.lit('{"type":"Feature","properties":'), properties,
        F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit("}"),
    )


def geojson_features(df: DataFrame, wkt: str = "geometria_wkt") -> DataFrame:
    """``value``: each row as a Feature, its WKT column replaced by the geometry."""
    geometry = geojson_from_parts(wkt_kind(F.col(wkt)), parts_from_wkt(F.col(wkt)))
    return df.select(feature_json(df, geometry, exclude=[wkt]).alias("value"))


def write_geojson(df: DataFrame, path: str, wkt: str = "geometria_wkt") -> None:
    """One Feature per line in parallel part files (newline-delimited GeoJSON)."""
    geojson_features(df, wkt).write.mode("overwrite").text(path)


def geojson_collections(df: DataFrame, order: Sequence[str], wkt: str = "geometria_wkt", per_page: int = 1000) -> DataFrame:
    """``page, value``: FeatureCollection documents of at most ``per_page`` features, in the order of ``order``."""
    numbered = surrogate_id(df, order, "_ordinal", first=0)
    geometry = geojson_from_parts(wkt_kind(F.col(wkt)), parts_from_wkt(F.col(wkt)))
    features = numbered.select(
        F.floor(F.col("_ordinal") / per_page).alias("page"), "_ordinal",
        feature_json(df, geometry, exclude=[wkt]).alias("feature"),
    )
    pages = features.groupBy("page").agg(
        F.array_sort(F.collect_list(F.struct("_ordinal", "feature"))).alias("rows")
    )
    body = F.array_join(F.transform("rows", lambda r: r["feature"]), ",")
    return pages.select("page", F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("value"))


def event_json(df: DataFrame) -> DataFrame:
    """``value``: each row as a JSON object in column order, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
