import json

import pytest
from pyspark.sql import functions as F

from emberline.session import work_folder
from emberline.sources.dimensions import load_dimension
from emberline.sources.readers import merge_geojson_pages, read_csv, read_facility_csv, read_geojson, read_sheet
from emberline.sources.storage import compact_by_year, time_range, write_by_year, write_fragments
from emberline.sources.writers import geojson_collections, write_csv


def feature(i):
    return {"type": "Feature", "properties": {"n": str(i)}, "geometry": {"type": "Point", "coordinates": [i, -i]}}


def write_page(folder, number, features):
    (folder / f"page_{number:03d}.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))


def test_pages_stop_at_the_first_short_one(spark, tmp_path):
    write_page(tmp_path, 0, [feature(1), feature(2)])
    write_page(tmp_path, 1, [feature(3)])
    write_page(tmp_path, 2, [feature(4), feature(5)])
    got = merge_geojson_pages(spark, str(tmp_path), ["n"], page_size=2)
    assert sorted(r["n"] for r in got.collect()) == ["1", "2", "3"]


def test_pages_stop_at_empty_and_missing_ones(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    for name, pages in (("a", {0: [feature(1), feature(2)], 1: [], 2: [feature(3), feature(4)]}),
                        ("b", {0: [feature(1), feature(2)], 2: [feature(3), feature(4)]})):
        for number, features in pages.items():
            write_page(tmp_path / name, number, features)
        got = merge_geojson_pages(spark, str(tmp_path / name), ["n"], page_size=2)
        assert sorted(r["n"] for r in got.collect()) == ["1", "2"]


def test_geojson_collections_are_bounded(spark, tmp_path):
    df = spark.range(25).select("id", F.format_string("POINT (%d 1)", "id").alias("geometria_wkt"))
    pages = geojson_collections(df, ["id"], per_page=10).orderBy("page").collect()
    sizes = [len(json.loads(p["value"])["features"]) for p in pages]
    assert sizes == [10, 10, 5]
    first = json.loads(pages[0]["value"])["features"][0]
    assert first == {"type": "Feature", "properties": {"id": 0}, "geometry": {"type": "Point", "coordinates": [0.0, 1.0]}}


def test_geojson_types(spark, tmp_path):
    shapes = [
        {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]},
        {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]},
        {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]},
        None,
    ]
    features = [{"type": "Feature", "id": i, "properties": {}, "geometry": g} for i, g in enumerate(shapes)]
    (tmp_path / "x.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = {r["feature_id"]: r["parts"] for r in read_geojson(spark, str(tmp_path), []).collect()}
    assert [len(got[k]) if got[k] else None for k in "0123"] == [1, 1, 1, None]
    assert len(got["1"][0]) == 2 and len(got["2"][0]) == 2


def test_sheet_with_title_rows(spark, tmp_path):
    (tmp_path / "legend.csv").write_text('Title,,\n"a, b",,\n-,,\nCode ID,"COLEÇÃO, 10"\n1,"1. Mata, densa"\n,x\n', encoding="utf-8")
    df = read_sheet(spark, str(tmp_path / "legend.csv"), skip_rows=3)
    assert df.columns == ["Code ID", "COLEÇÃO, 10"]
    assert [tuple(r) for r in df.collect()] == [("1", "1. Mata, densa"), (None, "x")]


def test_latin1_keeps_leading_zeros(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes("CO;NO\n007;São José\n".encode("latin-1"))
    assert [tuple(r) for r in read_facility_csv(spark, str(tmp_path / "f.csv")).collect()] == [("007", "São José")]


def test_csv_quotes_and_wkt(spark, tmp_path):
    df = spark.createDataFrame([('say "hi"', "POLYGON ((0 0, 1 0, 1 1, 0 0))", None, " x ")], "a string, g string, n string, s string")
    write_csv(df, str(tmp_path / "out"))
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "out")).collect()] == [tuple(df.first())]


def test_typed_load_tolerates_bad_cells(spark, tmp_path):
    (tmp_path / "dim_mapbiomas_municipios.csv").write_text(
        "extra,id_classe_solo,area_hectares,chave_localidade\nq,3.0,1.5,A_B\nq,NAO INFORMADO,x,C_D\nq,2.5,,E_F\n"
    )
    (tmp_path / "other.csv").write_text("a\n1\n")
    df = load_dimension(spark, str(tmp_path), "dim_mapbiomas_municipios", str(tmp_path / "table"))
    got = sorted((r["chave_localidade"], r["id_classe_solo"], r["area_hectares"], str(r["__time"])) for r in df.collect())
    assert got == [
        ("A_B", 3, 1.5, "2025-01-01 00:00:00"), ("C_D", None, None, "2025-01-01 00:00:00"),
        ("E_F", None, None, "2025-01-01 00:00:00"),
    ]
    assert df.columns[0] == "__time" and len(df.columns) == 9


def sample_fact(spark):
    return spark.range(2000).select(
        F.timestamp_seconds(F.lit(1600000000) + F.col("id") * 40000).alias("__time"),
        (F.col("id") % 3).cast("string").alias("risco_eletrico"), (F.col("id") % 5).cast("string").alias("bioma"),
        "id",
    )


def test_compaction_keeps_rows_and_merges_files(spark, tmp_path):
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    write_fragments(sample_fact(spark), source, files=40)
    compacted = compact_by_year(spark, source, target)
    assert sorted(r["id"] for r in compacted.collect()) == list(range(2000))
    files = list((tmp_path / "t").rglob("*.parquet"))
    years = {f.parent.name for f in files}
    assert len(list((tmp_path / "s").glob("*.parquet"))) == 40 and len(files) == len(years)


def test_files_hold_at_most_max_records(spark, tmp_path):
    write_by_year(sample_fact(spark), str(tmp_path / "t"), max_records=100)
    for file in (tmp_path / "t").rglob("*.parquet"):
        assert spark.read.parquet(str(file)).count() <= 100


def test_time_range_prunes_years(spark, tmp_path):
    write_by_year(sample_fact(spark), str(tmp_path / "t"))
    chosen = time_range(spark.read.parquet(str(tmp_path / "t")), "2021-03-01", "2021-04-01")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    want = sample_fact(spark).filter("__time >= '2021-03-01' AND __time < '2021-04-01'").count()
    assert chosen.count() == want > 0


def test_work_folder_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value or default

    class Session:
        def __init__(self, master, value=None):
            self.conf = Conf(value)
            self.sparkContext = type("C", (), {"master": master})

    assert work_folder(Session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError):
        work_folder(Session("yarn"))
