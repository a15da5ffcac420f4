"""SQL access: the fact and metrics as views, and ``TIME_FLOOR`` as a SQL function that Catalyst inlines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from emberline.plans.fact import FACT_TABLE

METRICS_TABLE = "system-metrics"

#: Calendar units by name, fixed lengths by arithmetic, as in ``timebuckets.time_floor``; anything else is an error.
_TIME_FLOOR = r"""
CREATE OR REPLACE TEMPORARY FUNCTION TIME_FLOOR(ts TIMESTAMP, period STRING)
RETURNS TIMESTAMP
RETURN CASE
  WHEN ts IS NULL OR period IS NULL THEN NULL
  WHEN period = 'PT1M' THEN date_trunc('minute', ts)
  WHEN period = 'PT1H' THEN date_trunc('hour', ts)
  WHEN period = 'P1D' THEN date_trunc('day', ts)
  WHEN period = 'P1W' THEN date_trunc('week', ts)
  WHEN period = 'P1M' THEN date_trunc('month', ts)
  WHEN period = 'P3M' THEN date_trunc('quarter', ts)
  WHEN period = 'P1Y' THEN date_trunc('year', ts)
  WHEN period RLIKE '^(PT[0-9]+[SMH]|P[0-9]+D)$' AND regexp_extract(period, '([0-9]+)', 1) RLIKE '[1-9]' THEN
    timestamp_seconds(floor(unix_timestamp(ts) / (
      CAST(regexp_extract(period, '([0-9]+)', 1) AS BIGINT)
      * CASE right(period, 1) WHEN 'S' THEN 1 WHEN 'M' THEN 60 WHEN 'H' THEN 3600 ELSE 86400 END
    )) * (
      CAST(regexp_extract(period, '([0-9]+)', 1) AS BIGINT)
      * CASE right(period, 1) WHEN 'S' THEN 1 WHEN 'M' THEN 60 WHEN 'H' THEN 3600 ELSE 86400 END
    ))
  ELSE CAST(raise_error(concat('unsupported period ', period)) AS TIMESTAMP)
END
"""

#: Settings under which queries written for the fact's former store are read: quoted names, strict arithmetic.
_DIALECT = {"spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true"}


def register(spark: SparkSession, fact: DataFrame | None = None, metrics: DataFrame | None = None,
             dimensions: Mapping[str, DataFrame] | None = None) -> None:
    """Make the tables and ``TIME_FLOOR`` known to ``spark.sql``; no setting of the session changes."""
    spark.sql(_TIME_FLOOR)
    if fact is not None:
        fact.createOrReplaceTempView(FACT_TABLE)
    if metrics is not None:
        metrics.createOrReplaceTempView(f"`{METRICS_TABLE}`")
    for name, df in (dimensions or {}).items():
        df.createOrReplaceTempView(name)


def quoted_sql(spark: SparkSession, text: str) -> DataFrame:
    """The query ``text``, in which double quotes enclose names. Only its reading is affected, not the session."""
    before = {key: spark.conf.get(key) for key in _DIALECT}
    try:
        for key, value in _DIALECT.items():
            spark.conf.set(key, value)
        return spark.sql(text)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
