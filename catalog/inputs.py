"""Inputs several queries share. Indexes and the fact are built once per session and folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.plans.enrichment import SpatialContext, build_context, clean_hotspots, locate
from emberline.plans.fact import build_fact, named_hotspots
from emberline.session import scratch_path
from emberline.sources.storage import write_by_year
from fixtures import ALTO_KM, MEDIO_KM, fixture

_CACHE: dict[tuple[str, str, str], object] = {}


def once(kind: str, spark: SparkSession, sf_dir: str, build):
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        _CACHE[key] = build()
    return _CACHE[key]


def layers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = {
        "terras": "lands", "municipios": "cities", "rodovias": "roads", "linhas": "lines",
        "subestacoes": "substations", "sistemas": "systems", "hospitais": "hospitals",
    }
    return {layer: fixture(spark, sf_dir, name) for layer, name in names.items()}


def context(spark: SparkSession, sf_dir: str) -> SpatialContext:
    return once(
        "context", spark, sf_dir,
        lambda: build_context(layers(spark, sf_dir)),
    )


def spread(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The test tables are single small files: share their rows among all tasks before per-row work."""
    return df.repartition(spark.sparkContext.defaultParallelism, "event_id")


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_hotspots(spread(spark, fixture(spark, sf_dir, "hotspots")))


def named(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    raw = spread(spark, fixture(spark, sf_dir, "hotspots")) if raw is None else raw
    located = locate(clean_hotspots(raw), context(spark, sf_dir))
    return named_hotspots(
        located, fixture(spark, sf_dir, "lands"), fixture(spark, sf_dir, "lines"), ALTO_KM, MEDIO_KM
    )


def fresh_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact as a plan over the tables, nothing stored."""
    return build_fact(
        spread(spark, fixture(spark, sf_dir, "hotspots")), context(spark, sf_dir), fixture(spark, sf_dir, "lands"),
        fixture(spark, sf_dir, "lines"), ALTO_KM, MEDIO_KM,
    )


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored fact, partitioned by year, built on first use."""

    def build() -> str:
        path = scratch_path(spark, "fact")
        write_by_year(fresh_fact(spark, sf_dir), path)
        return path

    return spark.read.parquet(once("fact", spark, sf_dir, build))
