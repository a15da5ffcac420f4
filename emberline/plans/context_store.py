"""Spatial contexts as versioned tables: indexes are published in one step and found by whoever asks for the newest.

Published indexes are not stored in buckets; large ones are joined by a shuffle of both sides.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from emberline.operators.spatial_index import CellIndex, Grid
from emberline.plans.enrichment import SpatialContext
from emberline.sources.versions import newest, publish, read, stage


def publish_context(spark: SparkSession, context: SpatialContext, path: str) -> int:
    """Store the indexes of ``context`` as the next version under ``path``; returns its number."""
    base = newest(spark, path)
    tables, kinds = {}, {}
    for kind, indexes in (("areas", context.areas), ("distances", context.distances)):
        kinds[kind] = []
        for number, index in enumerate(indexes):
            tables[f"{kind}_{number}"] = stage(index.leaves, path, f"{kind}_{number}")
            kinds[kind].append({"grid": asdict(index.grid), "layers": list(index.layers), "n_cells": index.n_cells, "n_entries": index.n_entries, "box": index.box})
    return publish(spark, path, base, tables, {"indexes": kinds}).number


class NewestContext:
    """Called with a session, gives the newest context published under ``path``; it is loaded once for each version."""

    def __init__(self, path: str):
        self.path, self._number, self._context = path, 0, None

    def __call__(self, spark: SparkSession) -> SpatialContext:
        version = newest(spark, self.path)
        if not version.number:
            raise ValueError(f"no context published under {self.path}")
        if version.number != self._number:
            def index(kind: str, number: int, about: dict) -> CellIndex:
                leaves: DataFrame = read(spark, self.path, f"{kind}_{number}", version)
                box = tuple(about["box"]) if about["box"] else None
                return CellIndex(leaves, Grid(**about["grid"]), tuple(about["layers"]), about["n_cells"], about["n_entries"], box)

            found = {kind: [index(kind, n, a) for n, a in enumerate(entries)] for kind, entries in version.info["indexes"].items()}
            self._number, self._context = version.number, SpatialContext(found["areas"], found["distances"])
        return self._context
