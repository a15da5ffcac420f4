"""Benchmark statistics and report tables.

The long form of the measurements has one row per run: ``consulta, armazenamento, nucleos, modo, rodada, ms``, with
``modo`` either ``cold`` or ``warm``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.numbers import percent_gain, two_decimals
from emberline.functions.text import display_name

RUNS = 7
MODES = ("cold", "warm")


def _total_and_count(column: Column) -> tuple[Column, Column]:
    """Sum in whole millionths (so the order of the rows does not matter) and number of values."""
    return F.sum(F.round(column * 1e6).cast("bigint")), F.count(column)


def _rounded_mean(total: Column, count: Column) -> Column:
    """Mean with 2 decimals, halves rounded up, from a sum in millionths."""
    return F.floor((total + count * 5000) / F.nullif(count * 10000, F.lit(0))) / 100.0


def run_statistics(runs: DataFrame, keys: Iterable[str] = ("consulta", "armazenamento", "nucleos")) -> DataFrame:
    """Mean cold and warm time and the cache gain in percent per query.

    With a column ``linhas`` (rows returned by the run) the count of the last run is kept, the largest if there are several.
    """
    keys = list(keys)
    parts = []
    for mode in MODES:
        total, count = _total_and_count(F.when(F.col("modo") == mode, F.col("ms")))
        parts += [total.alias(f"_{mode}_total"), count.alias(f"_{mode}_count")]
    extra = [F.max(F.struct("rodada", "linhas"))["linhas"].alias("linhas")] if "linhas" in runs.columns else []
    sums = runs.groupBy(*keys).agg(*parts, *extra)
    mean = {m: F.col(f"_{m}_total") / F.nullif(F.col(f"_{m}_count"), F.lit(0)) for m in MODES}
    return sums.select(
        *keys,
        _rounded_mean(F.col("_cold_total"), F.col("_cold_count")).alias("media_cold_ms"),
        _rounded_mean(F.col("_warm_total"), F.col("_warm_count")).alias("media_warm_ms"),
        percent_gain(mean["cold"], mean["warm"]).alias("ganho_cache_pct"),
        *(["linhas"] if extra else []),
    )


def wide_runs(runs: DataFrame, keys: Iterable[str] = ("consulta", "armazenamento", "nucleos")) -> DataFrame:
    """One column per run: ``Cold_1_ms`` ... ``Warm_7_ms`` (the last value of a repeated run counts)."""
    keys = list(keys)
    names = [f"{mode.capitalize()}_{i}_ms" for mode in MODES for i in range(1, RUNS + 1)]
    name = F.concat(F.initcap("modo"), F.lit("_"), F.col("rodada").cast("string"), F.lit("_ms"))
    return runs.withColumn("_n", name).groupBy(*keys).pivot("_n", names).agg(F.round(F.max("ms"), 2))


def long_runs(wide: DataFrame, keys: Iterable[str] = ("consulta", "armazenamento", "nucleos")) -> DataFrame:
    """The inverse of ``wide_runs``: one row per run."""
    keys = list(keys)
    values = [f"{mode.capitalize()}_{i}_ms" for mode in MODES for i in range(1, RUNS + 1)]
    rows = wide.unpivot(keys, [v for v in values if v in wide.columns], "coluna", "ms")
    parts = F.split("coluna", "_")
    return rows.select(
        *keys, F.lower(parts[0]).alias("modo"), parts[1].cast("int").alias("rodada"), "ms"
    ).filter(F.col("ms").isNotNull())


def stack_scenarios(tables: Mapping[tuple[str, int], DataFrame]) -> DataFrame:
    """Statistics tables of several scenarios as one, tagged with storage and cores."""
    stacked = None
    for (storage, cores), df in tables.items():
        tagged = df.withColumns({"armazenamento": F.lit(storage), "nucleos": F.lit(cores)})
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    return stacked


def scenario_means(statistics: DataFrame) -> DataFrame:
    """Mean of the cold and warm means per storage and number of cores."""

    def mean(name: str) -> Column:
        return _rounded_mean(*_total_and_count(F.col(name)))

    return statistics.groupBy("armazenamento", "nucleos").agg(
        mean("media_cold_ms").alias("media_cold_ms"), mean("media_warm_ms").alias("media_warm_ms")
    )


def cores_series(means: DataFrame, value: str = "media_cold_ms", cores: Iterable[int] = (2, 4, 6)) -> DataFrame:
    """One row per storage, one column per number of cores."""
    wide = means.groupBy("armazenamento").pivot("nucleos", list(cores)).agg(F.max(value))
    return wide.withColumnsRenamed({str(c): f"nucleos_{c}" for c in cores})


def cache_gain_series(statistics: DataFrame, text: str, cores: Iterable[int] = (2, 4, 6)) -> DataFrame:
    """Cache gain of the queries whose name contains ``text``: per query and storage, one column per cores."""
    chosen = statistics.filter(F.col("consulta").contains(text))
    wide = chosen.groupBy("consulta", "armazenamento").pivot("nucleos", list(cores)).agg(F.max("ganho_cache_pct"))
    return wide.withColumnsRenamed({str(c): f"nucleos_{c}" for c in cores})


def report_table(statistics: DataFrame, tag: str = "", rows: str | None = None) -> DataFrame:
    """Display table: readable name, times and gain as text with 2 decimals, and the row count if given."""
    cells = [
        display_name(F.col("consulta"), tag).alias("consulta"),
        two_decimals(F.col("media_cold_ms")).alias("cold"),
        two_decimals(F.col("media_warm_ms")).alias("warm"),
        F.concat(two_decimals(F.col("ganho_cache_pct")), F.lit("%")).alias("ganho"),
    ]
    if rows:
        cells.append(F.col(rows).cast("string").alias("linhas"))
    return statistics.select(*cells)
