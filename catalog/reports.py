"""Benchmark statistics and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from emberline.operators import benchstats as B
from emberline.session import materialize
from fixtures import fixture, oracle


def _mean(column: str) -> str:
    micro = f"CAST(sum(CAST(round({column} * 1e6) AS BIGINT)) AS BIGINT)"
    return f"floor(({micro} + count({column}) * 5000) / (count({column}) * 10000e0)) / 1e2"


def _exact(column: str) -> str:
    return f"CAST(sum(CAST(round({column} * 1e6) AS BIGINT)) AS DOUBLE) / count({column})"


STATISTICS = f"""
SELECT consulta, armazenamento, nucleos, {_mean('cold')} AS media_cold_ms, {_mean('warm')} AS media_warm_ms,
  CASE WHEN {_exact('cold')} > 0
       THEN round(({_exact('cold')} - {_exact('warm')}) / ({_exact('cold')}) * 100e0, 2) ELSE 0e0 END AS ganho_cache_pct,
  max({{'r': rodada, 'l': linhas}}).l AS linhas
FROM (SELECT *, CASE WHEN modo = 'cold' THEN ms END AS cold, CASE WHEN modo = 'warm' THEN ms END AS warm FROM runs)
GROUP BY 1, 2, 3"""


def statistics(spark, sf):
    return B.run_statistics(fixture(spark, sf, "runs"))


@query("bench_stats", oracle(STATISTICS))
def _(spark, sf):
    return statistics(spark, sf)


@query("scenario_means", oracle(f"""
SELECT armazenamento, nucleos, {_mean('media_cold_ms')} AS media_cold_ms, {_mean('media_warm_ms')} AS media_warm_ms
FROM ({STATISTICS}) GROUP BY 1, 2"""))
def _(spark, sf):
    stored = materialize(statistics(spark, sf), "statistics")
    per_scenario = {
        (storage, cores): stored
        .filter((F.col("armazenamento") == storage) & (F.col("nucleos") == cores))
        .drop("armazenamento", "nucleos")
        for storage in ("fragmentado", "compactado")
        for cores in (2, 4, 6)
    }
    return B.scenario_means(B.stack_scenarios(per_scenario))


@query("cold_by_cores", oracle(f"""
SELECT armazenamento, max(CASE WHEN nucleos = 2 THEN m END) AS nucleos_2, max(CASE WHEN nucleos = 4 THEN m END) AS nucleos_4,
  max(CASE WHEN nucleos = 6 THEN m END) AS nucleos_6
FROM (SELECT armazenamento, nucleos, {_mean('media_cold_ms')} AS m FROM ({STATISTICS}) GROUP BY 1, 2) GROUP BY 1"""))
def _(spark, sf):
    return B.cores_series(B.scenario_means(statistics(spark, sf)))


@query("cache_gain_series", oracle(f"""
SELECT consulta, armazenamento, max(CASE WHEN nucleos = 2 THEN ganho_cache_pct END) AS nucleos_2,
  max(CASE WHEN nucleos = 4 THEN ganho_cache_pct END) AS nucleos_4, max(CASE WHEN nucleos = 6 THEN ganho_cache_pct END) AS nucleos_6
FROM ({STATISTICS}) WHERE contains(consulta, 'FUNAI') GROUP BY 1, 2"""))
def _(spark, sf):
    return B.cache_gain_series(statistics(spark, sf), "FUNAI")


@query("unpivot_runs", oracle("""
SELECT consulta, armazenamento, nucleos, modo, rodada, round(max(ms), 2) AS ms FROM runs GROUP BY 1, 2, 3, 4, 5"""))
def _(spark, sf):
    return B.long_runs(B.wide_runs(fixture(spark, sf, "runs")))


@query("report_table", oracle(f"""
SELECT replace(replace(consulta, '_Cenario', ''), '_', ' ') AS consulta, printf('%.2f', media_cold_ms) AS cold,
  printf('%.2f', media_warm_ms) AS warm, printf('%.2f', ganho_cache_pct) || '%' AS ganho, CAST(linhas AS VARCHAR) AS linhas
FROM ({STATISTICS})"""))
def _(spark, sf):
    return B.report_table(statistics(spark, sf), "_Cenario", rows="linhas")
