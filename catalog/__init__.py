"""The registered queries: one key per operator, with the SQL that checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``oracle`` is its complete DuckDB text."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        _QUERIES[name] = run
        if oracle:
            _ORACLES[name] = oracle.strip()
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in ("scalars", "tables", "spatial", "olap", "reports", "files", "dimensions", "streams"):
        importlib.import_module(f"catalog.{module}")
    return dict(_QUERIES), dict(_ORACLES)
