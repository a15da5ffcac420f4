"""Fact, analytical queries and operational metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.inputs import cleaned, fact, fresh_fact
from emberline.functions.timebuckets import time_floor
from emberline.operators import analytics as A
from emberline.operators.heavy import top_groups
from emberline.plans.sql_surface import quoted_sql, register
from fixtures import fixture, oracle


@query("minute_rollup", oracle("SELECT * FROM fact"))
def _(spark, sf):
    return fresh_fact(spark, sf)


@query("bench1_hourly_series", oracle("""
SELECT date_trunc('hour', __time) AS janela_hora, CAST(sum(total_focos) AS BIGINT) AS volume_focos_hora,
  max(frp_maximo) AS pico_calor_registrado, min(dist_linha_minima_km) AS aproximacao_maxima_torres
FROM fact GROUP BY 1 ORDER BY 1 DESC LIMIT 100"""))
def _(spark, sf):
    return A.hourly_series(fact(spark, sf))


@query("bench1_recent_hours", oracle("""
SELECT date_trunc('hour', __time) AS janela_hora, CAST(sum(total_focos) AS BIGINT) AS volume_focos_hora,
  max(frp_maximo) AS pico_calor_registrado, min(dist_linha_minima_km) AS aproximacao_maxima_torres
FROM fact GROUP BY 1 ORDER BY 1 DESC LIMIT 100"""))
def _(spark, sf):
    return A.recent_hourly_series(fact(spark, sf))


@query("bench2_high_cardinality", oracle("""
SELECT municipio, bioma, CAST(sum(total_focos) AS BIGINT) AS total_focos
FROM fact GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50"""))
def _(spark, sf):
    return A.busiest_municipalities(fact(spark, sf))


@query("bench2_sketched", oracle("""
SELECT municipio, bioma, CAST(sum(total_focos) AS BIGINT) AS total_focos
FROM fact GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50"""))
def _(spark, sf):
    return top_groups(fact(spark, sf), ["municipio", "bioma"], "total_focos", 50)


@query("top_parts", """
SELECT l_partkey, l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS unidades FROM lineitem GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""")
def _(spark, sf):
    """The largest of very many groups of about equal size, where a sketch can rule out fewer of them."""
    items = fixture(spark, sf, "SELECT l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS unidades FROM lineitem")
    return top_groups(items, ["l_partkey", "l_suppkey"], "unidades", 20)


@query("bench3_complex_filters", oracle("""
SELECT satelite, count(*) AS fatias_de_minuto_processadas, CAST(sum(total_focos) AS BIGINT) AS focos_reais
FROM fact WHERE risco_eletrico = 'ALTO' AND bioma = 'Amazônia' AND em_terra_indigena = 'true' GROUP BY 1"""))
def _(spark, sf):
    return A.satellite_counts(fact(spark, sf))


BI1 = """
SELECT linha_afetada, estado, CAST(sum(total_focos) AS BIGINT) AS ocorrencias_criticas,
  min(dist_linha_minima_km) AS menor_distancia_km, max(frp_maximo) AS intensidade_maxima_fogo
FROM fact WHERE risco_eletrico = 'ALTO' AND linha_afetada <> 'N/A'
GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 15"""


@query("bi1_line_risk", oracle(BI1))
def line_risk(spark, sf):
    return A.line_risk_ranking(fact(spark, sf))


@query("bi2_indigenous_lands", oracle("""
SELECT nome_ti, estado, bioma, CAST(sum(total_focos) AS BIGINT) AS focos_registrados, max(frp_maximo) AS pico_energia_frp
FROM fact WHERE em_terra_indigena = 'true' AND nome_ti <> 'Nenhuma'
GROUP BY 1, 2, 3 ORDER BY 5 DESC, 1, 2, 3 LIMIT 10"""))
def _(spark, sf):
    return A.indigenous_land_ranking(fact(spark, sf))


@query("bi3_state_risk", oracle("""
SELECT estado, risco_eletrico, CAST(sum(total_focos) AS BIGINT) AS volume_focos,
  min(dist_subestacao_minima_km) AS menor_dist_subestacao_estado
FROM fact GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2"""))
def _(spark, sf):
    return A.state_risk_matrix(fact(spark, sf))


@query("ops_latency", oracle("""
SELECT metric_name, CAST(avg(value) AS DECIMAL(10, 2)) AS tempo_medio_ms, CAST(max(value) AS DECIMAL(10, 2)) AS pior_caso_ms
FROM metrics WHERE unit = 'ms' GROUP BY 1 ORDER BY 2 DESC, 1"""))
def _(spark, sf):
    return A.latency_summary(fixture(spark, sf, "metrics"))


@query("ops_throughput", oracle("""
SELECT date_trunc('minute', __time) AS minuto, round(sum(value), 2) AS total_registros
FROM metrics WHERE metric_name = 'kafka_ingest_count' GROUP BY 1 ORDER BY 1 DESC"""))
def _(spark, sf):
    per_minute = A.throughput_per_minute(fixture(spark, sf, "metrics"))
    # sums of doubles depend on the order of the rows in the last digits
    return per_minute.withColumn("total_registros", F.round("total_registros", 2))


@query("time_floor", oracle("""
SELECT event_id, date_trunc('minute', ts) AS pt1m, date_trunc('hour', ts) AS pt1h, date_trunc('day', ts) AS p1d,
  date_trunc('month', ts) AS p1m, date_trunc('year', ts) AS p1y, time_bucket(INTERVAL 15 MINUTE, ts) AS pt15m,
  time_bucket(INTERVAL 6 HOUR, ts) AS pt6h
FROM events"""))
def _(spark, sf):
    ts = F.col("ts").cast("timestamp")
    periods = ("PT1M", "PT1H", "P1D", "P1M", "P1Y", "PT15M", "PT6H")
    events = fixture(spark, sf, "SELECT event_id, ts FROM events")
    return events.select("event_id", *[time_floor(ts, p).alias(p.lower()) for p in periods])


@query("time_floor_sql", oracle("""
SELECT date_trunc('hour', ts) AS h, time_bucket(INTERVAL 15 MINUTE, ts) AS quarter, time_bucket(INTERVAL 30 SECOND, ts) AS half, count(*) AS n
FROM events GROUP BY ALL"""))
def _(spark, sf):
    register(spark)
    fixture(spark, sf, "SELECT ts FROM events").createOrReplaceTempView("floor_events")
    return quoted_sql(spark, """
SELECT TIME_FLOOR(CAST("ts" AS TIMESTAMP), 'PT1H') AS h, TIME_FLOOR(CAST("ts" AS TIMESTAMP), 'PT15M') AS quarter,
  TIME_FLOOR(CAST("ts" AS TIMESTAMP), 'PT30S') AS half, count(*) AS n FROM "floor_events" GROUP BY ALL""")


@query("daily_peak", oracle("""
WITH hourly AS (SELECT municipio, date_trunc('hour', __time) AS hora, CAST(sum(total_focos) AS BIGINT) AS focos
                FROM fact GROUP BY 1, 2),
ranked AS (SELECT *, CAST(hora AS DATE) AS dia,
  CAST(sum(focos) OVER (PARTITION BY municipio, CAST(hora AS DATE) ORDER BY hora) AS BIGINT) AS acumulado,
  row_number() OVER (PARTITION BY municipio, CAST(hora AS DATE) ORDER BY focos DESC, hora) AS pos FROM hourly)
SELECT municipio, dia, CAST(hour(hora) AS INTEGER) AS hora_pico, focos AS focos_pico, acumulado AS acumulado_ate_pico
FROM ranked WHERE pos = 1"""))
def _(spark, sf):
    return A.daily_peak(fact(spark, sf))


@query("heat_grid", oracle("""
SELECT floor(longitude) AS lon, floor(latitude) AS lat, count(*) AS focos,
  CAST(sum(CAST(potencia_radiativa_fogo AS DECIMAL(18, 4))) AS DOUBLE) AS frp_total,
  max(potencia_radiativa_fogo) AS frp_maximo
FROM clean WHERE NOT isnan(longitude) AND NOT isnan(latitude) GROUP BY 1, 2"""))
def _(spark, sf):
    return A.heat_grid(cleaned(spark, sf))


@query("alert_matrix", oracle("""
WITH cells AS (SELECT estado, risco_eletrico, em_terra_indigena, CAST(sum(total_focos) AS BIGINT) AS focos,
  max(frp_maximo) AS frp_maximo, min(dist_linha_minima_km) AS menor_distancia_km FROM fact GROUP BY 1, 2, 3)
SELECT *, CASE WHEN risco_eletrico = 'ALTO' AND (em_terra_indigena = 'true' OR frp_maximo >= 100) THEN 'CRITICO'
  WHEN risco_eletrico IN ('ALTO', 'MEDIO') OR em_terra_indigena = 'true' THEN 'ATENCAO' ELSE 'NORMAL' END AS alerta
FROM cells"""))
def _(spark, sf):
    return A.alert_matrix(fact(spark, sf))
