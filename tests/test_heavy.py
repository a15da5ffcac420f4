import random

from pyspark.sql import functions as F

from emberline.operators import heavy
from emberline.operators.ids import in_order, surrogate_id


def want(rows, limit):
    sums = {}
    for a, b, v in rows:
        sums.setdefault((a, b), []).append(v)
    totals = [(k, sum(x for x in v if x is not None) if any(x is not None for x in v) else None) for k, v in sums.items()]
    totals.sort(key=lambda t: (t[1] is None, -(t[1] or 0), t[0][0] is not None, t[0][0] or "", t[0][1]))
    return [(*k, v) for k, v in totals[:limit]]


def got(spark, rows, limit):
    return [tuple(r) for r in heavy.top_groups(spark.createDataFrame(rows, "a string, b int, v long"), ["a", "b"], "v", limit).collect()]


def test_equals_the_sums_of_all_groups(spark, monkeypatch):
    rnd = random.Random(1)
    skewed = [(f"k{int(rnd.paretovariate(0.4)) % 5000}", rnd.randrange(2), rnd.randrange(5)) for _ in range(6000)]
    flat = [(f"k{i % 500}", 0, 1) for i in range(2000)]
    for buckets in (heavy.BUCKETS, 16):
        monkeypatch.setattr(heavy, "BUCKETS", buckets)
        for rows in (skewed, flat, [(None, 1, 3), (None, 1, None), ("x", 1, None), ("y", 2, 3)], [("a", 1, -5), ("b", 1, 2), ("c", 1, -1), ("a", 1, 9)], []):
            for limit in (1, 3, 50):
                assert got(spark, rows, limit) == want(rows, limit)


def test_few_groups_are_shuffled(spark):
    df = spark.range(400_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 40).otherwise(F.col("id")).alias("k"), F.lit(1).cast("long").alias("v"))
    floor = df.groupBy("k").agg(F.sum("v").alias("s")).orderBy(F.desc("s")).limit(20).agg(F.min("s")).first()[0]
    reaching = heavy.sketch(df, ["k"], "v").filter(F.col("total") >= floor)
    left = heavy.in_buckets(df, ["k"], reaching, range(heavy.ROWS)).select("k").distinct().count()
    groups = df.select("k").distinct().count()
    assert groups > 200_000 and 20 <= left < 200


def test_ids_of_a_tie_are_spread_and_repeatable(spark):
    df = spark.range(50_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(7)).alias("k"), F.when(F.col("id") % 10 == 0, "x").otherwise("same").alias("t"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in in_order(df, ["k"]).filter("t = 'same'").groupBy("_part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(sizes) >= 7 and max(sizes) < 2 * 45_000 / 7
    runs = [sorted(tuple(r) for r in surrogate_id(df.repartition(n), ["k"], "i", 5).collect()) for n in (3, 11)]
    assert runs[0] == runs[1] and sorted(r[2] for r in runs[0]) == list(range(5, 50_005))
    assert [r[0] for r in sorted(runs[0], key=lambda r: r[2])] == sorted(r[0] for r in runs[0])
    nested = spark.sql("SELECT map('a', id) AS m, id % 3 AS k FROM range(30)")
    assert sorted(r["i"] for r in surrogate_id(nested, ["k"], "i").collect()) == list(range(1, 31))
