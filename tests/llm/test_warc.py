import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from emberline.llm import warc as W

PAGES = "page_id long, url string, html string, payload int"


def read(df, low=0):
    spark = df.sparkSession
    records = W.page_records(W.read_warc(spark, W.write_warc(df, low)))
    return sorted(map(tuple, records.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[3]))


def test_round_trip_with_revisits_nulls_and_repeats(llm):
    rows = [(5, "u", "a"), (2, "u\r\n é", "a"), (9, None, "a"), (1, "u", None), (7, "u", ""), (3, "u", "é" * 9), (None, "u", "a"), (None, "u", "z"), (2, "u", "a")]
    got = read(llm.createDataFrame([(*r, 0) for r in rows], PAGES))
    digest = {t: W.payload_digest(t.encode()) for t in ("a", "", "é" * 9, "z")}
    assert got == [
        (1, 0, digest[""], "response", None), (2, 1, digest["a"], "response", None), (2, 1, digest["a"], "response", None),
        (3, 18, digest["é" * 9], "response", None), (5, 1, digest["a"], "revisit", 2), (7, 0, digest[""], "revisit", 1),
        (9, 1, digest["a"], "revisit", 2), (None, 1, digest["z"], "response", None), (None, 1, digest["a"], "revisit", 2),
    ]


def test_small_payloads_and_empty_table(llm):
    df = llm.createDataFrame([(1, "u", "ab", 0), (2, "u", "ab", 0), (3, "u", "abc", 0), (4, "u", "abc", 0)], PAGES)
    assert [r[3] for r in read(df, 3)] == ["response", "response", "response", "revisit"]
    assert read(df.limit(0)) == []


def test_archives_roll_and_payloads_come_back_whole(llm, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 3000)
    df = llm.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), F.repeat(F.md5(F.col("id").cast("string")), 40)).alias("html"))
    manifest = W.write_warc(df.repartition(3))
    assert manifest.count() > 5
    back = W.read_warc(llm, manifest)
    assert back.groupBy("archive").count().count() == manifest.count()
    assert {(r[0], bytes(r[1]).decode()) for r in back.select("page_id", "payload").collect()} == {(r[0], r[1]) for r in df.select("page_id", "html").collect()}
    first = manifest.first()["archive"]
    with open(first, "rb") as f:
        magic, size = struct.unpack("<II", f.read(8))
    assert magic == W.DICTIONARY_MAGIC and size > 0


def archive(*frames, dictionary=b""):
    return io.BytesIO(struct.pack("<II", W.DICTIONARY_MAGIC, len(dictionary)) + dictionary + b"".join(frames))


def test_compressed_dictionary_and_plain_archives():
    samples = [W.build_record(i, "u", bytes(str(i * 7919), "ascii") * 30, None, False) for i in range(200)]
    trained = zstandard.train_dictionary(4096, samples)
    coder = zstandard.ZstdCompressor(dict_data=trained)
    packed = archive(*map(coder.compress, samples), dictionary=zstandard.ZstdCompressor().compress(trained.as_bytes()))
    assert [d for _, d in W.Frames(packed)] == samples
    assert [d for _, d in W.Frames(io.BytesIO(b"".join(map(zstandard.ZstdCompressor().compress, samples))))] == samples
    assert list(W.Frames(io.BytesIO(b""))) == []


def test_damage_is_found():
    good = W.build_record(1, "u", b"payload", None, False)
    press = zstandard.ZstdCompressor(write_checksum=True).compress
    assert W.parse_record(good).payload == b"payload"
    for bad in (good[:-1], good + b"x", good.replace(b"payload\r\n", b"pAyload\r\n"), good.replace(b"WARC/1.1", b"WARK/1.1"), good.replace(b"WARC-Type: ", b"WARC-Type "), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"\nContent-Length: ", b"\nContent-Length: x", 1)):
        with pytest.raises(W.BadArchive):
            W.parse_record(bad)
    for stream in (archive(press(good)[:-3]), archive(press(good), b"junk"), archive(press(good), press(good)[:3])):
        with pytest.raises((W.BadArchive, zstandard.ZstdError)):
            list(W.Frames(stream))


def test_several_tasks_read(llm, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 3000)
    df = llm.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), F.repeat(F.md5(F.col("id").cast("string")), 40)).alias("html"))
    manifest = W.write_warc(df.repartition(3))
    names = manifest.count()
    assert names > 5
    tasks = W.read_warc(llm, manifest.unionByName(manifest)).groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("archive").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert len(tasks) >= names * 2 // 3 and max(r["n"] for r in tasks) <= 3
    assert sum(r["n"] for r in tasks) == names and sum(r["rows"] for r in tasks) == 300
