import json
import random

import pytest

from emberline.sources.ranges import csv_records, geojson_features, split_csv
from emberline.sources.readers import read_csv, read_geojson, read_large_geojson
from emberline.sources.writers import write_csv


@pytest.fixture(params=["300", "2500", "128m"])
def ranges(spark, request):
    """Byte ranges of some sizes, so that their borders fall everywhere."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(df):
    """Sorted; nested JSON text without the spaces that the two readers keep or not."""
    return sorted(tuple(json.dumps(json.loads(v)) if k == "deep" and v else str(v) for k, v in r.asDict().items()) for r in df.collect())


def awkward(rnd):
    return "".join(rnd.choice(['a', ' ', '}', '{', '"', '\\', '\n', '[', ']', ',', 'é', ':', '"features":[']) for _ in range(rnd.choice([0, 1, 3, 12])))


def feature(rnd, i):
    lines = [[[rnd.randint(-9, 9), rnd.random()] for _ in range(rnd.choice([2, 5, 40]))] for _ in range(2)]
    shape = rnd.choice([{"type": "Point", "coordinates": [i, -i]}, {"type": "MultiLineString", "coordinates": lines}, None])
    out = {"type": "Feature", "id": i, "properties": {"n": awkward(rnd), "deep": {"x": [{"y": awkward(rnd)}]}, "m": None if i % 7 == 0 else awkward(rnd)}, "geometry": shape}
    names = list(out)
    rnd.shuffle(names)
    return {k: out[k] for k in names}


def test_one_document_equals_the_reader_of_whole_documents(spark, tmp_path, ranges):
    rnd = random.Random(1)
    for number, indent in enumerate((None, 2)):
        document = {"type": "FeatureCollection", "name": 'a "{" }', "crs": {"type": "name", "properties": {"name": "x}{"}}}
        document |= {"features": [feature(rnd, 100 * number + i) for i in range(60)], "more": [{"type": "Feature", "id": 999}, {"a": {}}], "last": {"b": "}"}}
        (tmp_path / f"{number}.json").write_text(json.dumps(document, indent=indent, ensure_ascii=number == 0), encoding="utf-8")
    (tmp_path / "2.json").write_text('{"type":"FeatureCollection","features":[]}')
    (tmp_path / "3.json").write_text('{"features" : [ {"id": 7, "properties": {"n": "}"}} ]\n}\n')
    got, want = (f(spark, str(tmp_path), ["n", "m", "deep"]) for f in (read_large_geojson, read_geojson))
    assert got.schema == want.schema and got.count() == 121
    assert rows(got) == rows(want)


def test_a_document_that_breaks_off_gives_what_stands_before(spark, tmp_path, ranges):
    (tmp_path / "x.json").write_text('{"features":[{"id":1,"properties":{"n":"a"}},{"id":2,"properties":{"n":"b"}},{"id":3,"prop')
    assert [r["feature_id"] for r in read_large_geojson(spark, str(tmp_path), ["n"]).orderBy("feature_id").collect()] == ["1", "2"]


def test_many_tasks_read_one_document(spark, tmp_path):
    document = {"type": "FeatureCollection", "features": [feature(random.Random(i), i) for i in range(3000)]}
    (tmp_path / "x.json").write_text(json.dumps(document))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        text = spark.read.option("lineSep", "}").text(str(tmp_path))
        assert text.rdd.getNumPartitions() > 5
        plan = geojson_features(spark, str(tmp_path))
        assert plan.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_with_line_ends_in_cells(spark, tmp_path, ranges):
    rnd = random.Random(2)
    cell = lambda: None if rnd.random() < 0.2 else awkward(rnd) or None
    data = [(cell(), cell(), str(i)) for i in range(300)]
    df = spark.createDataFrame(data, "`a b` string, `q\"` string, i string")
    write_csv(df.repartition(3), str(tmp_path / "out"))
    got = split_csv(spark, str(tmp_path / "out"))
    assert got.columns == df.columns and rows(got) == rows(df)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "x.csv").write_bytes("a;b\r\n1;São\r\n\r\n2;\"x\r\ny\"\r\n;".encode("latin-1"))
    got = split_csv(spark, str(tmp_path / "plain"), ";", "ISO-8859-1")
    assert rows(got) == rows(spark.createDataFrame([("1", "São"), ("2", "x\r\ny"), (None, None)], "a string, b string"))


def test_csv_without_line_ends_in_cells_is_not_sorted(spark, tmp_path, ranges):
    (tmp_path / "x.csv").write_text("a,b\n" + "".join(f"{i},\"v,{i}\"\n" for i in range(200)))
    got = split_csv(spark, str(tmp_path))
    assert rows(got) == sorted((str(i), f"v,{i}") for i in range(200))
    records = csv_records(spark, str(tmp_path))
    assert records.filter("_head").count() == 1 and records.count() == 201


def test_csv_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"x\ny",,x\n1,2,3,4\n5\n')
    got = split_csv(spark, str(tmp_path))
    assert got.columns == ["x\ny", "_c1", "x"] and rows(got) == [("1", "2", "3"), ("5", "None", "None")]
    (tmp_path / "b.csv").write_text("other\n1\n")
    with pytest.raises(ValueError):
        split_csv(spark, str(tmp_path))
    assert read_csv(spark, str(tmp_path), glob="b.csv", multiline=True).collect()[0]["other"] == "1"
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "c.csv").write_text("")
    assert split_csv(spark, str(tmp_path / "none")).columns == []
