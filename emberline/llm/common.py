"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.session import materialize

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers that start on this machine import the package, whatever the working folder is.

    On a cluster the package is installed or sent with ``--py-files``, as for any PySpark job.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = os.environ.get("PYTHONPATH", "")
    spark.sparkContext.environment.setdefault("PYTHONPATH", f"{root}:{known}" if known else root)
    return spark


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_total(df: DataFrame, order: Sequence[str], value: str, out: str, label: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows up to this one in the order of ``order``.

    The rows are range-sorted over all tasks and written once; each partition then adds the total of those before it.
    The table of partition totals has one row per partition, which bounds its broadcast. ``order`` must be unique
    for a result that does not depend on the partitions.
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        placed.join(F.broadcast(before), "_part")
        .withColumn(out, F.col("_before") + F.sum(value).over(inside))
        .drop("_part", "_before")
    )
