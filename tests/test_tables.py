import pytest
from pyspark.sql import functions as F

from emberline.functions.timebuckets import time_floor
from emberline.operators import analytics as A
from emberline.operators import benchstats as B
from emberline.operators.ids import surrogate_id
from emberline.operators.joins import salted_left_join, sized_left_join
from emberline.operators.landcover import clean_legend
from emberline.operators.lookups import legend_join, name_lookup
from emberline.operators.rollup import electric_risk, minute_rollup
from emberline.plans.sql_surface import quoted_sql, register
from emberline.schemas import DIMENSIONS, FACT


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_salted_join_equals_plain_join(spark):
    # one key holds a third of the rows, some keys match nothing or several rows, some are null
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 != 0, F.col("id") % 50).alias("k"), F.col("id").alias("v")
    )
    right = spark.range(60).select((F.col("id") % 40).alias("k"), F.col("id").alias("w"))
    assert rows(salted_left_join(left, right, ["k"])) == rows(left.join(right, "k", "left"))


def test_salted_join_spreads_null_keys(spark):
    left = spark.range(2000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(10, "x"), (None, "y")], "k long, w string")
    joined = salted_left_join(left, right, ["k"])
    assert rows(joined) == rows(left.join(right, "k", "left"))
    adaptive, limit = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = salted_left_join(left, right, ["k"]).select("k", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    parts = [sum(r["p"] == p for r in placed if r["k"] is None) for p in range(8)]
    assert sum(parts) == 1800 and min(parts) > 0 and max(parts) < 450


def test_chained_salted_joins_read_the_left_side_once(spark, tmp_path):
    spark.range(100).select(*[(F.col("id") % (n + 2)).alias(f"k{n}") for n in range(4)]).write.parquet(str(tmp_path / "left"))
    joined = spark.read.parquet(str(tmp_path / "left"))
    for n in range(4):
        right = spark.range(5).select(F.col("id").alias(f"k{n}"), F.col("id").alias(f"w{n}"))
        joined = salted_left_join(joined, right, [f"k{n}"])
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_sized_join_broadcasts_only_below_the_bound(spark):
    left, right = spark.range(10).withColumnRenamed("id", "k"), spark.range(10).withColumnRenamed("id", "k")
    hinted = sized_left_join(left, right, ["k"])._jdf.queryExecution().analyzed().toString()
    plain = sized_left_join(left, right, ["k"], row_bytes=10**9)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in hinted.lower() and "broadcast" not in plain.lower()


def test_surrogate_ids_are_consecutive(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"), (F.col("id") % 3).alias("g"))
    got = surrogate_id(df.repartition(9), ["g", "k"], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 5001))
    assert [(r["g"], r["k"]) for r in got] == sorted((r["g"], r["k"]) for r in got)


def test_legend_join_matches_missing_codes_and_repeats(spark):
    cover = spark.createDataFrame([("a", 1), ("b", None), ("c", 9)], "t string, class_id bigint")
    legend = spark.createDataFrame(
        [("1", "1. X"), ("1.0", "1.1 Y"), ("z", "5. W"), (None, "2. V"), ("3", None)], "code string, label string"
    )
    got = legend_join(cover, clean_legend(legend, "code", "label")).select("t", "uso_cobertura_solo", "categoria_macro")
    assert rows(got) == [
        ("a", "1. X", "1. Floresta"), ("a", "1.1 Y", "1. Floresta"), ("b", "5. W", "5. Corpo D'água"), ("c", None, None),
    ]


def test_name_lookup_never_multiplies(spark):
    df = spark.createDataFrame([(1,), (2,), (-1,)], "k bigint")
    dim = spark.createDataFrame([("1", "b"), ("1", "a"), ("x", "q")], "id string, name string")
    with pytest.raises(Exception):
        name_lookup(df, "k", dim, "id", "name", "out", "N/A").collect()  # ids are expected to be numbers
    dim = dim.filter("id <> 'x'")
    assert rows(name_lookup(df, "k", dim, "id", "name", "out", "N/A")) == [(-1, "N/A"), (1, "a"), (2, "N/A")]


def test_risk_levels(column):
    assert column(electric_risk, [-1.0, 0.0, 1.0, 1.01, 5.0, 5.01], "double") == [
        "BAIXO", "ALTO", "ALTO", "MEDIO", "MEDIO", "BAIXO"
    ]


def test_rollup_conserves_counts_and_ignores_sentinels(spark):
    base = dict(municipio="M", estado="E", bioma="B", satelite="S", risco_eletrico="ALTO", em_terra_indigena="false",
                nome_ti="Nenhuma", linha_afetada="N/A")
    data = [
        {**base, "momento": "2024-01-01 10:00:10", "potencia_radiativa_fogo": 5.0, "distancia_linha_km": -1.0, "distancia_subestacao_km": 3.0},
        {**base, "momento": "2024-01-01 10:00:50", "potencia_radiativa_fogo": 9.0, "distancia_linha_km": 2.0, "distancia_subestacao_km": -1.0},
        {**base, "momento": "2024-01-01 10:01:00", "potencia_radiativa_fogo": 1.0, "distancia_linha_km": -1.0, "distancia_subestacao_km": -1.0},
    ]
    df = spark.createDataFrame(data).withColumn("momento", F.col("momento").cast("timestamp"))
    fact = minute_rollup(df)
    assert fact.columns == FACT.fieldNames()
    got = [tuple(r)[-4:] for r in fact.orderBy("__time").collect()]
    assert got == [(2, 9.0, 2.0, 3.0), (1, 1.0, None, None)]


def fact_rows(spark, data):
    return spark.createDataFrame(data, "__time string, municipio string, estado string, bioma string, satelite string, "
        "risco_eletrico string, em_terra_indigena string, nome_ti string, linha_afetada string, total_focos bigint, "
        "frp_maximo double, dist_linha_minima_km double, dist_subestacao_minima_km double").withColumn(
        "__time", F.col("__time").cast("timestamp"))


def small_fact(spark):
    return fact_rows(spark, [
        ("2024-01-01 10:00:00", "A", "X", "Amazônia", "S1", "ALTO", "true", "T1", "L1", 3, 9.0, 0.5, 2.0),
        ("2024-01-01 10:30:00", "A", "X", "Amazônia", "S1", "ALTO", "true", "T1", "L1", 2, 11.0, 0.25, None),
        ("2024-01-01 11:00:00", "B", "X", "Cerrado", "S2", "ALTO", "false", "Nenhuma", "L2", 5, 1.0, 0.75, 1.0),
        ("2024-01-01 12:00:00", "C", "Y", "Cerrado", "S2", "BAIXO", "true", None, "N/A", 5, 7.0, None, 4.0),
        ("2024-01-02 12:00:00", "C", "Y", None, "S2", "BAIXO", "true", "T2", None, 1, 8.0, None, 3.0),
    ])


def test_rankings_break_ties_by_key_and_drop_null_names(spark):
    fact = small_fact(spark)
    assert [tuple(r) for r in A.line_risk_ranking(fact).collect()] == [
        ("L1", "X", 5, 0.25, 11.0), ("L2", "X", 5, 0.75, 1.0)
    ]
    assert [tuple(r) for r in A.indigenous_land_ranking(fact).collect()] == [
        ("T1", "X", "Amazônia", 5, 11.0), ("T2", "Y", None, 1, 8.0)
    ]
    assert [tuple(r) for r in A.satellite_counts(fact).collect()] == [("S1", 2, 5)]
    assert [r["volume_focos"] for r in A.state_risk_matrix(fact).collect()] == [10, 6]


def test_daily_peak(spark):
    got = {(r["municipio"], str(r["dia"])): tuple(r)[2:] for r in A.daily_peak(small_fact(spark)).collect()}
    assert got[("A", "2024-01-01")] == (10, 5, 5) and got[("C", "2024-01-02")] == (12, 1, 1)


def test_sql_surface_reads_quoted_names_without_touching_the_session(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    before = {k: session.conf.get(k) for k in ("spark.sql.ansi.enabled", "spark.sql.ansi.doubleQuotedIdentifiers")}
    small_fact(spark).write.mode("overwrite").saveAsTable("surface_fact")
    metrics = session.sql("SELECT TIMESTAMP '2024-01-01 10:00:30' AS __time, 'n' AS metric_name, 4D AS value")
    register(session, session.table("surface_fact"), metrics)
    by_day = quoted_sql(session, """SELECT TIME_FLOOR("__time", 'P1D') AS d, count(*) AS n, sum("total_focos") AS f
        FROM "queimadas_focos_calor" GROUP BY TIME_FLOOR("__time", 'P1D')""").collect()
    assert sum(r["f"] for r in by_day) == 16
    assert quoted_sql(session, 'SELECT max("value") AS top FROM "system-metrics"').first()["top"] == 4.0
    assert before == {k: session.conf.get(k) for k in before}
    assert session.sql('SELECT "text" AS t').first()["t"] == "text"
    spark.sql("DROP TABLE surface_fact")


def test_time_floor_in_sql_knows_every_period_of_the_column_form(spark):
    register(spark)
    rows = spark.sql("SELECT TIMESTAMP '2024-05-17 13:47:31' AS ts UNION ALL SELECT CAST(NULL AS TIMESTAMP)")
    for period in ("PT1M", "PT1H", "P1D", "P1W", "P1M", "P3M", "P1Y", "PT15M", "PT30S", "PT6H", "P2D"):
        both = rows.select(F.expr(f"TIME_FLOOR(ts, '{period}')").alias("a"), time_floor(F.col("ts"), period).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in both) and both[0]["a"] is not None
    for period in ("PT0M", "P1X", "hour"):
        with pytest.raises(Exception, match="unsupported period"):
            rows.select(F.expr(f"TIME_FLOOR(ts, '{period}')")).collect()


def test_statistics(spark):
    runs = spark.createDataFrame(
        [("Q_a", "f", 2, "cold", i, 100.0 + i) for i in range(1, 8)] + [("Q_a", "f", 2, "warm", i, 52.0) for i in range(1, 8)]
        + [("Q_b", "f", 2, "warm", 1, 5.0)],
        "consulta string, armazenamento string, nucleos int, modo string, rodada int, ms double",
    )
    got = {r["consulta"]: tuple(r)[3:] for r in B.run_statistics(runs).collect()}
    assert got == {"Q_a": (104.0, 52.0, 50.0), "Q_b": (None, 5.0, 0.0)}
    wide = B.wide_runs(runs)
    assert wide.columns[3:5] == ["Cold_1_ms", "Cold_2_ms"] and wide.columns[-1] == "Warm_7_ms"
    assert B.long_runs(wide).count() == 15
    table = B.report_table(B.run_statistics(runs).filter("consulta = 'Q_a'"), "_a").first()
    assert tuple(table) == ("Q", "104.00", "52.00", "50.00%")


def test_dimension_specs():
    assert len(DIMENSIONS) == 11
    assert DIMENSIONS["dim_ons_subestacoes"].time.startswith("2010")
