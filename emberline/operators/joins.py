"""Equi-joins that stay safe when a side is large or a key is hot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.session import BROADCAST_BYTES, has_at_most, materialize

#: Rows with a null key are dealt to so many places.
NULL_SALTS = 1 << 20
#: Keys of bucketed tables lie above; numbers from here down match nothing.
UNMATCHED = -(1 << 20)
#: Keys with fewer rows are never taken for hot.
HOT_ROWS = 100_000


def salted_left_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of two large relations that no key can pile up in one task.

    Rows with a null key match nothing; a salt that is part of the join key spreads them, as they may be most of the rows.
    Other hot keys are left to adaptive execution, which splits the partitions of the left side that turn out large; a stream, which
    that does not reach, still has its null keys spread. So
    neither side is read ahead to look for them, and chains of joins read ``left`` once. The salt is a hash of the other
    columns, so that a task that runs again after a lost executor sends its rows to the same places.
    """
    on = list(on)
    others = [c for c, t in left.dtypes if c not in on and "map<" not in t] or on
    unknown = reduce(or_, [F.col(c).isNull() for c in on])
    salt = F.when(unknown, F.pmod(F.xxhash64(*others), F.lit(NULL_SALTS))).otherwise(F.lit(0))
    spread = left.withColumn("_salt", salt.cast("int"))
    # always 0, but no literal: Catalyst would turn the comparison with one into a filter and drop it from the join key
    zero = F.pmod(F.xxhash64(*on), F.lit(1)).cast("int")
    return spread.join(right.withColumn("_salt", zero), [*on, "_salt"], "left").drop("_salt")


def bucketed_left_join(left: DataFrame, right: DataFrame, on: str, buckets: int, hot_bytes: Column) -> DataFrame:
    """Left join on a number with a table stored in ``buckets`` by it: ``left`` is brought to the buckets, ``right`` is not shuffled.

    ``right`` has one row per key, and no key below ``UNMATCHED``. Adaptive execution cannot split such a join, so keys with
    more than half of the mean rows of a bucket are counted first; there are fewer than twice as many as buckets. Their rows of ``right``
    are broadcast if their size, the sum of ``hot_bytes``, stays in bounds. Null keys, and those found so, get
    numbers that match nothing and spread over the buckets. A stream cannot be counted and takes the salted join, as do keys whose rows of ``right`` are
    too large.
    """
    if left.isStreaming:
        return salted_left_join(left, right, [on])
    counts = materialize(left.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    keys = counts.filter(F.col("_n") > max(total / (2 * buckets), HOT_ROWS)).select(on)
    # at most 2 * buckets numbers
    hot = materialize(right.join(F.broadcast(keys), on, "left_semi"), "hot-keys")
    if (hot.agg(F.sum(hot_bytes)).first()[0] or 0) > BROADCAST_BYTES:
        return salted_left_join(left, right, [on])
    columns, values = left.columns, [c for c in right.columns if c != on]
    hot = hot.select(F.col(on), F.lit(True).alias("_hot"), *[F.col(c).alias(f"_h_{c}") for c in values])
    others = [c for c, t in left.dtypes if c != on and "map<" not in t] or [on]
    nowhere = F.lit(UNMATCHED) - F.pmod(F.xxhash64(*others), F.lit(NULL_SALTS))
    spread = left.join(F.broadcast(hot), on, "left").withColumn("_key", F.when(F.col("_hot") | F.col(on).isNull(), nowhere).otherwise(F.col(on)))
    joined = spread.join(right.withColumnRenamed(on, "_key"), "_key", "left")
    return joined.select(*columns, *[F.when(F.col("_hot"), F.col(f"_h_{c}")).otherwise(F.col(c)).alias(c) for c in values])


def sized_left_join(left: DataFrame, right: DataFrame, on: Sequence[str], row_bytes: int = 1024) -> DataFrame:
    """Left join that broadcasts ``right`` if its counted size allows, and salts hot keys otherwise."""
    if has_at_most(right, BROADCAST_BYTES // row_bytes):
        return left.join(F.broadcast(right), list(on), "left")
    return salted_left_join(left, right, on)
