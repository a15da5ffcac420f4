"""The largest of very many groups, without shuffling the groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.session import materialize

#: Counters of a row of the sketch, and rows. They bound what is shuffled and broadcast: BUCKETS * ROWS rows of 24 bytes.
BUCKETS, ROWS = 1 << 16, 3
#: The first guess looks at the groups in so many buckets for each group asked for.
GUESSES = 4


def _bucket(keys: Sequence[str], row: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(row), *keys), F.lit(BUCKETS)).cast("int")


def sketch(df: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """``row``, ``bucket``, ``total``, ``least``: a count-min sketch of the sums of ``measure`` by ``keys``, and the least value.

    Every task adds up its own rows by bucket, so at most a row for each bucket and task is shuffled, whatever the number of groups.
    A group's sum is at most the total of its bucket in each row of the sketch, as no value is below zero.
    """
    value = F.coalesce(F.col(measure), F.lit(0))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("row"), _bucket(keys, r).alias("bucket")) for r in range(ROWS)]))
    placed = df.select(each.alias("at"), value.alias("value")).select("at.*", "value")
    return placed.groupBy("row", "bucket").agg(F.sum("value").alias("total"), F.min("value").alias("least"))


def in_buckets(df: DataFrame, keys: Sequence[str], chosen: DataFrame, rows: Sequence[int]) -> DataFrame:
    """The rows of ``df`` whose group lies in a bucket of ``chosen`` in each of ``rows`` of the sketch."""
    for r in rows:
        found = chosen.filter(F.col("row") == r).select(F.col("bucket").alias("_bucket"))
        # at most BUCKETS rows
        df = df.join(F.broadcast(found), _bucket(keys, r) == F.col("_bucket"), "left_semi")
    return df


def top_groups(df: DataFrame, keys: Sequence[str], measure: str, limit: int) -> DataFrame:
    """``keys`` and the sum of ``measure`` (under its name) of the ``limit`` groups with the highest sums, ties by the keys; exact.

    1. A sketch bounds the sum of every group from above. 2. The groups in the largest buckets are summed exactly; the sum at
    place ``limit`` among them is a floor for the result. 3. Only groups whose buckets all reach the floor can belong to it: these are summed
    exactly. So the table is read three times, and what is shuffled grows with the number of large groups. Where
    that proves nothing - a measure below zero, or fewer groups than asked for - all groups are summed.
    """
    keys = list(keys)

    def exact(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum(measure).alias(measure)).orderBy(F.col(measure).desc(), *keys).limit(limit)

    totals = materialize(sketch(df, keys, measure), "sketch")
    if (totals.agg(F.min("least")).first()[0] or 0) < 0:
        return exact(df)
    largest = totals.filter("row = 0").orderBy(F.col("total").desc(), "bucket").limit(GUESSES * limit)
    guess = exact(in_buckets(df, keys, largest, [0])).agg(F.count(measure).alias("n"), F.min(measure).alias("floor")).first()
    if guess["n"] < limit:
        return exact(df)
    reaching = totals.filter(F.col("total") >= F.lit(guess["floor"]))
    return exact(in_buckets(df, keys, reaching, range(ROWS)))
