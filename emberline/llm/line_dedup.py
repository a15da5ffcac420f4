"""Line dedup: lines that many sites share are boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import WORD, let
from emberline.session import broadcast_if_small, materialize

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 10
#: Base-two logarithm of a sketch's registers; its standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 10
#: Upper estimate for a row of the table of shared lines, which is broadcast if its counted size allows.
HASH_ROW_BYTES = 256
#: Estimates within so many standard errors of the threshold are counted exactly.
ERRORS = 4


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """A row per line with a word: the row it is from, its place, its hash and its site."""
    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    every = docs.select("_row", "doc_id", F.col(site).cast("string").alias("site"), F.posexplode(split).alias("place", "line"))
    return every.filter(F.col("line").rlike(WORD)).select("_row", "doc_id", "site", "place", F.unhex(F.md5(F.col("line").cast("binary"))).alias("hash"))


def shared_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """The hashes of lines on at least ``min_sites`` distinct sites, with the line that stays (``first``).

    A HyperLogLog sketch of the sites per line hash is built in each task and merged after the shuffle, so a line that
    stands on a third of all rows sends one sketch per task. Lines whose estimate is within ERRORS standard errors of the threshold are
    counted exactly, from distinct pairs of line and site; beyond, the sketch alone decides.
    """
    margin = ERRORS * 1.04 / (2 ** (lg_k / 2))
    low, high = min_sites * (1 - margin) - 0.5, min_sites * (1 + margin) + 0.5
    spread = lines.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min(F.struct("doc_id", "place")).alias("first")
    ).filter(F.col("n") >= min_sites).select("hash", "first", F.hll_sketch_estimate("sketch").alias("estimate"))
    spread = materialize(spread.filter(F.col("estimate") >= low), "line-spread")
    near = broadcast_if_small(spread.filter(F.col("estimate") <= high).select("hash"), HASH_ROW_BYTES)
    pairs = lines.join(near, "hash", "left_semi").filter("site IS NOT NULL").select("hash", "site").distinct()
    exact = pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("sites"))
    wide = spread.join(exact, "hash", "left").filter((F.col("sites") >= min_sites) | (F.col("sites").isNull() & (F.col("estimate") > high)))
    return wide.select("hash", "first")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", lg_k: int = LG_K) -> DataFrame:
    """``docs`` without the lines that stand on at least ``min_sites`` distinct sites, with ``n_lines`` (lines of the
    input) and ``n_removed``; one row per row of ``docs`` (``doc_id``, ``text``, the site column and any others).

    Lines end at ``\\n`` and compare as they stand, by MD5. Lines without a word never count and are never removed.
    Of each boilerplate line the first copy stays (smallest ``doc_id``, null first; then smallest place), so that a
    corpus with many copies of a page keeps one of them whole. Kept lines are joined by ``\\n`` again. A null site is no
    site; a null or empty text is left as it is; repeated rows with one ``doc_id`` are judged alike; columns called
    ``n_lines`` or ``n_removed`` are replaced. Only hashes are shuffled to find the lines; texts move once, to meet the
    places of the lines to remove.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", "_row")]
    rows = docs.select(*kept).withColumn("_row", F.xxhash64("doc_id", "text", F.col(site)))
    lines = materialize(_lines(rows, site), "lines")
    # a few boilerplate lines meet the others where they are; many are joined by hash
    shared = broadcast_if_small(materialize(shared_lines(lines, min_sites, lg_k), "shared-lines"), HASH_ROW_BYTES)
    out = (
        lines.join(shared, "hash").filter(~F.struct("doc_id", "place").eqNullSafe(F.col("first")))
        .groupBy("_row", F.col("doc_id").alias("_doc")).agg(F.collect_set("place").alias("_places"))  # one entry per line of the text at most
    )
    split = F.split(F.col("text"), "\n", -1)
    left = let(split, lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_places")), lambda i: F.get(ls, i)))
    text = F.when(F.col("_places").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    joined = rows.join(out.withColumnRenamed("_row", "_at"), (F.col("_row") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return joined.select(
        *(text.alias(c) if c == "text" else F.col(c) for c in kept),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.when(F.col("_places").isNull(), 0).otherwise(F.size("_places")).cast("long").alias("n_removed"),
    )
