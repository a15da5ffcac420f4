"""Storage of the fact: yearly partitions, compaction of small files, time-range reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import delete_path, materialize

MAX_RECORDS_PER_FILE = 5_000_000
#: Columns the files are sorted by, so that row groups can be skipped by the usual filters.
SORT_COLUMNS = ("risco_eletrico", "bioma")


def write_by_year(
    df: DataFrame, path: str, *, time: str = "__time", sort: Sequence[str] = SORT_COLUMNS,
    max_records: int = MAX_RECORDS_PER_FILE, mode: str = "overwrite", overwrite: str = "static",
) -> None:
    """Few, large, sorted files per year. Overwriting replaces the whole table, or with ``overwrite="dynamic"`` the years in ``df``.

    The rebalance hint lets AQE split a year that is too large for one task and merge small ones, so neither a single
    year nor many small inputs decide the number of files.
    """
    sort = [c for c in sort if c in df.columns]
    placed = df.withColumn("year", F.year(time)).hint("rebalance", "year")
    placed = placed.sortWithinPartitions("year", *sort)
    placed.write.mode(mode).options(maxRecordsPerFile=max_records, partitionOverwriteMode=overwrite).partitionBy("year").parquet(path)


def replace_days(spark: SparkSession, path: str, rows: DataFrame, days: Sequence[str], *, time: str = "__time", **options) -> None:
    """Replace the rows of ``days`` (``yyyy-MM-dd``) in the yearly table at ``path`` by ``rows``; doing it again changes nothing.

    The touched years are written aside in whole first, then put in place by one job that overwrites just their
    partitions; all other years stay as they are. Rows of ``rows`` on other days are refused.
    """
    if not days:
        return
    dates = [F.lit(d).cast("date") for d in days]
    years = sorted({int(d[:4]) for d in days})
    stored = spark.read.parquet(path)
    names = [c for c in stored.columns if c != "year"]
    fresh = rows.select(*names)
    left = stored.filter(F.col("year").isin(years) & ~F.col(time).cast("date").isin(*dates)).select(*names)
    merged = materialize(left.unionByName(fresh), "replaced")
    outside = merged.filter(~F.year(time).isin(years))
    if not outside.isEmpty() or fresh.filter(~F.col(time).cast("date").isin(*dates)).count():
        raise ValueError("rows to put in place lie outside the given days")
    write_by_year(merged, path, time=time, overwrite="dynamic", **options)
    held = {r["y"] for r in merged.select(F.year(time).alias("y")).distinct().collect()}  # the touched years
    for year in set(years) - held:
        delete_path(spark, f"{path}/year={year}")


def write_fragments(df: DataFrame, path: str, files: int, time: str = "__time") -> None:
    """Many small files, as a stream leaves them; the starting point of a compaction."""
    df.withColumn("year", F.year(time)).repartition(files).write.mode("overwrite").parquet(path)


def compact_by_year(spark: SparkSession, source: str, target: str, **options) -> DataFrame:
    """Rewrite the small files under ``source`` into yearly blocks under ``target``."""
    df = spark.read.parquet(source)
    write_by_year(df.drop("year"), target, **options)
    return spark.read.parquet(target)


def time_range(df: DataFrame, start: str, end: str, time: str = "__time") -> DataFrame:
    """Rows with ``start <= time < end``; the partition column is filtered too, so other years are not read."""
    years = F.col("year").between(F.year(F.lit(start).cast("timestamp")), F.year(F.lit(end).cast("timestamp")))
    moment = F.col(time)
    return df.filter(
        years & (moment >= F.lit(start).cast("timestamp")) & (moment < F.lit(end).cast("timestamp"))
    )
