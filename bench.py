"""Benchmark: prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

``queries`` holds seconds: the six analytical queries and the operational ones on yearly blocks (median of the runs
after one warm-up), the six again on many small files (``*_fragmented``), and the jobs that build the data (one
run each). ``*_3m_cold`` and ``*_3m_warm`` are the six on 3.1 million rows, first run and median. ``value`` is the sum over the six queries on yearly blocks.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from catalog.inputs import context, fact, spread
from emberline.operators import analytics as A
from emberline.operators.heavy import top_groups
from emberline.plans.enrichment import enrich_hotspots
from emberline.session import build_session, release, scratch_path
from emberline.sources.storage import compact_by_year, write_by_year, write_fragments
from emberline.streaming.merge import merged_measures
from fixtures import fixture

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
#: Rows of the published runs.
LARGE_ROWS = int(os.environ.get("BENCH_LARGE_ROWS", "3100000"))
FRAGMENTS = int(os.environ.get("BENCH_FRAGMENTS", "400"))

SIX = {
    "bench1_hourly_series": A.hourly_series,
    "bench2_high_cardinality": A.busiest_municipalities,
    "bench3_complex_filters": A.satellite_counts,
    "bi1_line_risk": A.line_risk_ranking,
    "bi2_indigenous_lands": A.indigenous_land_ranking,
    "bi3_state_risk": A.state_risk_matrix,
}


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 4)


def median(action, runs: int = RUNS) -> float:
    action()
    return round(statistics.median(seconds(action) for _ in range(runs)), 4)


def store(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]",
        **{
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": CPUS,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    fixture(spark, SF_DIR, "SELECT count(*) FROM events").collect()
    times: dict[str, float] = {}

    times["index_build"] = seconds(lambda: context(spark, SF_DIR))
    times["fact_build"] = seconds(lambda: fact(spark, SF_DIR))
    hotspots = spread(spark, fixture(spark, SF_DIR, "hotspots"))
    times["enrich_hotspots"] = median(lambda: store(enrich_hotspots(hotspots, context(spark, SF_DIR))), 2)

    table = fact(spark, SF_DIR)
    small, blocks = scratch_path(spark, "fragments"), scratch_path(spark, "blocks")
    write_fragments(table.drop("year"), small, FRAGMENTS)
    times["compact_yearly"] = seconds(lambda: compact_by_year(spark, small, blocks))
    compacted, fragmented = spark.read.parquet(blocks), spark.read.parquet(small)
    for name, query in SIX.items():
        times[name] = median(lambda query=query: query(compacted).collect())
    for name, query in SIX.items():
        times[f"{name}_fragmented"] = median(lambda query=query: query(fragmented).collect(), 2)

    # the size of the published runs: the fact's rows on further days of the same years
    days = -(-LARGE_ROWS // max(1, compacted.count()))
    shifted = F.expr(f"explode(sequence(0, {days - 1}))")
    large = compacted.drop("year").withColumn("_day", shifted).withColumn("__time", F.expr("__time + make_dt_interval(_day * 11)")).drop("_day")
    path = scratch_path(spark, "large")
    times["write_large"] = seconds(lambda: write_by_year(large, path))
    published = spark.read.parquet(path)
    for name, query in SIX.items():
        times[f"{name}_3m_cold"] = seconds(lambda query=query: query(published).collect())
    for name, query in SIX.items():
        times[f"{name}_3m_warm"] = median(lambda query=query: query(published).collect(), 3)

    # the hourly table that the stream keeps (streaming/merge.py), here made from all rows
    hours = scratch_path(spark, "hours")
    published.groupBy(F.date_trunc("hour", "__time").alias("__time")).agg(*merged_measures()).coalesce(1).write.parquet(hours)
    times["bench1_hourly_table_3m_warm"] = median(lambda: A.hourly_series(spark.read.parquet(hours)).collect(), 3)
    times["bench2_sketched_3m_warm"] = median(lambda: top_groups(published, ["municipio", "bioma"], "total_focos", 50).collect(), 3)

    metrics = fixture(spark, SF_DIR, "metrics")
    times["ops_latency"] = median(lambda: A.latency_summary(metrics).collect())
    times["ops_throughput"] = median(lambda: A.throughput_per_minute(metrics).collect())
    times["daily_peak"] = median(lambda: store(A.daily_peak(compacted)))

    print(json.dumps({
        "metric": "six analytical queries on yearly blocks, sum of medians",
        "value": round(sum(times[name] for name in SIX), 4),
        "unit": "sec",
        "queries": times,
        "sf": SF_DIR.rsplit("sf", 1)[-1],
        "cpus": int(CPUS),
        "fact_rows": compacted.count(),
        "fragments": FRAGMENTS,
    }))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
