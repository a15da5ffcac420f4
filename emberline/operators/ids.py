"""Surrogate ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.session import materialize

_POSITION_MASK = (1 << 33) - 1


def in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows range-partitioned and sorted by ``order``, with ``_part`` and ``_pos`` (the place in its partition).

    Rows that agree in ``order`` are told apart by a hash of all their columns, and rows that are equal by their number in a written
    table, so that a tie of any size is dealt to as many partitions as other rows would be. Both follow ``order`` in the sort; which
    of two equal rows comes first makes no difference to anyone.
    """
    hashed = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    numbered = materialize(df.withColumn("_tie", F.xxhash64(*hashed)).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    keys = [*order, "_tie", "_row"]
    placed = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie", "_row")
    return placed.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)))


def surrogate_id(df: DataFrame, order: Sequence[str], out: str, first: int = 1) -> DataFrame:
    """Add consecutive ids ``first, first + 1, ...`` in the order of the columns ``order``.

    The rows are range-partitioned and sorted in parallel; each partition is then shifted by the number of rows
    before it, so no task ever sees all rows, nor all rows of a tie. The sorted rows are written once, because the shift and the
    positions must come from the same run. The ids are the same in every run, up to rows that are equal in all columns.
    """
    placed = materialize(in_order(df, order), "ordered")
    # one row per partition
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(offsets), "_part")
    return numbered.withColumn(out, F.col("_before") + F.col("_pos") + first).drop("_part", "_pos", "_before", "_n")
