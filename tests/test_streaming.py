from pyspark.sql import functions as F

from emberline.plans.enrichment import build_context, clean_hotspots, locate
from emberline.plans.fact import build_fact, named_hotspots
from emberline.schemas import FACT, RAW_HOTSPOT
from emberline.sources.writers import write_csv
from emberline.streaming.hotspots import (
    enrich_stream,
    file_stream,
    parse_events,
    rebuild_days,
    rollup_stream,
    start_event_sink,
    start_fact_sink,
)


def raw(spark, rows):
    return spark.createDataFrame(
        [(t, "Pará", "Belém", -1.0 - k / 10, -48.0, "Amazônia", "AQUA", 1.0, 0.0, 0.5, float(k)) for k, t in enumerate(rows)],
        RAW_HOTSPOT,
    )


def context(spark):
    lines = spark.createDataFrame([(1, "L", "LINESTRING (-48 -1, -47 -1)")], "id_linha_transmissao long, nome_linha string, geometria_wkt string")
    return build_context({"linhas": lines}), lines


def canonical(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_rollup_drops_late_rows_and_rebuild_recovers_them(spark, tmp_path):
    ctx, lines = context(spark)
    arrivals, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        stream = file_stream(spark, f"{arrivals}/*")
        named = named_hotspots(locate(clean_hotspots(stream), ctx), None, lines)
        start_fact_sink(rollup_stream(named, "10 minutes"), out, state, available_now=True).awaitTermination()

    batches = [
        ["2024-01-01 10:00:10", "2024-01-01 10:00:20", "2024-01-01 10:05:00"],
        ["2024-01-01 12:00:00"],
        ["2024-01-01 10:00:30"],  # later than the watermark
        ["2024-01-02 00:00:00"],
    ]
    everything = None
    for number, times in enumerate(batches):
        df = raw(spark, times)
        everything = df if everything is None else everything.unionByName(df)
        write_csv(df, f"{arrivals}/{number}")
        run()  # every run resumes from the checkpoint
    streamed = spark.read.parquet(out).select(*FACT.fieldNames())
    assert streamed.agg(F.sum("total_focos")).first()[0] == 4
    rebuilt = rebuild_days(everything, ["2024-01-01"], ctx, None, lines)
    assert rebuilt.agg(F.sum("total_focos")).first()[0] == 5
    whole = build_fact(everything, ctx, None, lines).filter("__time < '2024-01-02'")
    assert canonical(rebuilt) == canonical(whole)


def test_event_stream_equals_batch(spark, tmp_path):
    ctx, _ = context(spark)
    df = raw(spark, ["2024-01-01 10:00:10", "x", None])
    write_csv(df, str(tmp_path / "in"))
    enriched = enrich_stream(file_stream(spark, str(tmp_path / "in")), ctx)
    start_event_sink(enriched, str(tmp_path / "s"), "text", available_now=True, path=str(tmp_path / "o")).awaitTermination()
    batch = enrich_stream(df, ctx)
    assert canonical(parse_events(spark.read.text(str(tmp_path / "o")), batch.schema)) == canonical(batch)
