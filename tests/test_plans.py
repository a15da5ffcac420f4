"""The shape of the physical plans."""

from catalog.inputs import cleaned, context, fact
from emberline.operators import analytics as A
from emberline.plans.enrichment import enriched_record, locate
from emberline.sources.storage import write_by_year
from fixtures import fixture

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_enrichment_is_broadcast_and_free_of_python(spark):
    text = plan(enriched_record(locate(cleaned(spark, SF), context(spark, SF))))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "EvalPython" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    # the only exchange of points is the one that spreads the small test file
    assert text.count("Exchange hashpartitioning") <= 1


def test_enrichment_reads_only_the_needed_columns(spark):
    points = cleaned(spark, SF).select("event_id", "latitude", "longitude")
    text = plan(locate(points, context(spark, SF)).select("event_id", "id_linha_transmissao"))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in text


def test_rankings_push_filters_and_take_ordered(spark):
    text = plan(A.line_risk_ranking(fact(spark, SF)))
    assert "TakeOrderedAndProject" in text
    assert "EqualTo(risco_eletrico,ALTO)" in text and "Not(EqualTo(linha_afetada,N/A))" in text
    assert text.count("Exchange hashpartitioning") == 1


def test_metrics_read_two_columns(spark):
    text = plan(A.latency_summary(fixture(spark, SF, "metrics")))
    assert "props" not in text and "user_id" not in text


def test_recent_hours_leave_older_years_unread(spark, tmp_path):
    hours = spark.range(1000).selectExpr(
        "timestamp '2022-12-01' + make_interval(0, 0, 0, 0, cast(id * 13 as int)) AS __time", "id AS total_focos", "1D AS frp_maximo", "2D AS dist_linha_minima_km"
    )
    path = str(tmp_path / "fact")
    write_by_year(hours, path, sort=[])
    table = spark.read.parquet(path)
    recent = A.recent_hourly_series(table)
    filters = [line for line in plan(recent).splitlines() if "PartitionFilters" in line]
    assert filters and all("2024" in line and "2023" not in line for line in filters)
    assert [tuple(r) for r in recent.collect()] == [tuple(r) for r in A.hourly_series(table).collect()]
