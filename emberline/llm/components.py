"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import materialize

#: Rounds after which the search gives up with an error; the rounds needed grow with the logarithm of the longest path.
MAX_ROUNDS = 60


def _star(pairs: DataFrame, label: str) -> DataFrame:
    """Every (node, neighbour) of ``pairs`` as an edge from the neighbour to the smallest of node and neighbours."""
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m")), f"{label}-least")
    joined = pairs.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c"))
    center = F.least("m", "u")
    moved = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), center.alias("v")), F.struct(F.col("u"), center.alias("v")))).alias("e")).select("e.*")
    return materialize(moved.filter("u > v").distinct(), label)


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable, itself included) for every node of ``edges`` (``u``, ``v`` long).

    Alternates two steps until nothing changes: link the larger neighbours of each node to its smallest neighbour, then
    its smaller ones. Both only take a minimum per node, written as a table, and join it back; as that join is no longer tied to the
    aggregation, Spark splits the partition of a node with many neighbours, and it is never gathered in one place. Each round is a written table. Edges with a null end and loops are ignored; an empty
    table gives an empty result.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("u") != F.col("v")).alias("ok")).filter("ok").drop("ok").distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m")), "least")
        large = both.filter("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        now = _star(large, "stars")
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))).alias("s")).first()
        if seen == mark or not seen["n"]:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
