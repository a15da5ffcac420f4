"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.llm.common import WORD, running_total
from emberline.session import broadcast_if_small, materialize

#: Weights of the sources in code-point order, repeated as often as needed.
WEIGHTS = (5, 2, 1)
#: Words in the mix, as a share of all words.
BUDGET = 1.5
#: A document is taken this often at most, and so a source gives this many times its size at most.
EPOCHS = 2
#: Upper estimate for a row of the table of sources.
SOURCE_ROW_BYTES = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: ``rank`` (code-point order, null last), ``source_size``, ``earlier`` (words of the sources
    ranked before) and ``target``.

    The budget is shared by weight. A source whose share exceeds ``epochs`` times its size gets that much, and the rest
    is shared again. Ordered by size per weight, the capped sources come first; the number of them is the smallest for
    which the level (words per unit of weight) of the others exceeds none of their caps. Only this table, with one row
    per source, is ordered in one task.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    capped_first = Window.orderBy(F.col("_cap") / F.col("_weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(ranked) - 1)
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("_cap", (F.col("source_size") * epochs).cast("long"))
        .withColumn("earlier", F.coalesce(F.sum("source_size").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_budget", F.lit(budget) * F.sum("source_size").over(every))
        .withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_cap").over(capped_first), F.lit(0)))
        .withColumn("_open", F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(capped_first), F.lit(0)))
        .withColumn("_level", F.col("_left") / F.col("_open"))
    )
    # the level is right at the first source that it does not fill; if it fills all, all are capped
    level = F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_weight"), "rank", "_level"))).over(every)
    target = F.least(F.col("_cap").cast("double"), F.col("_found") * F.col("_weight"))
    return totals.withColumn("_found", level["_level"]).select("source", "rank", "source_size", "earlier", "_budget", target.alias("target"))


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: str = "mix"
) -> DataFrame:
    """How much of each document a mix of ``budget`` times all words takes: one row per row of ``docs`` (``doc_id``,
    ``source``, ``text``) with ``size``, ``source_size``, ``target`` (of its source), ``copies`` and ``taken`` (words).

    Weighted fair queueing: the documents of a source queue in the order of a seeded hash, one epoch after the other.
    A copy's virtual finish time is the words its source has sent by its end, divided by the source's target. All copies
    are range-sorted by that time, and the mix ends where its words would exceed the budget. The order is a function of
    the rows alone, so reruns agree. A source may hold any share of the rows: its running total is one range of a global
    one, never a group in one task.

    A null text has size 0; documents without words are never taken; a null source is a source; a null ``doc_id`` queues
    as the empty string; rows with one ``doc_id`` queue by size and are else alike; an empty table gives an empty mix.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sizes = materialize(sizes.select("*", F.monotonically_increasing_id().alias("row"), key.alias("key")), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, budget, epochs), "mix-targets")
    targets = broadcast_if_small(targets.withColumnRenamed("source", "_source"), SOURCE_ROW_BYTES)
    rows = sizes.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    queued = running_total(rows, ["rank", "key", "doc_id", "size", "row"], "size", "sent", "mix-queues")
    sent = F.col("sent") - F.col("earlier") + F.col("epoch") * F.col("source_size")
    finish = F.when(F.col("target") > 0, sent / F.col("target")).otherwise(F.lit(0.0))
    copies = queued.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("finish", finish)
    line = running_total(copies, ["finish", "rank", "key", "doc_id", "epoch", "size", "row"], "size", "mixed", "mix-line")
    took = (F.col("mixed") <= F.col("_budget")) & (F.col("size") > 0)
    return line.groupBy("row", "doc_id", "source", "size", "source_size", "target").agg(
        F.count(F.when(took, 1)).alias("copies"), F.coalesce(F.sum(F.when(took, F.col("size"))), F.lit(0)).cast("long").alias("taken")
    ).drop("row")


def take_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """``docs`` with each row as often as ``mix_sources`` takes it: not at all, once, or up to ``epochs`` times.

    Rows that agree in ``doc_id``, ``source`` and size stand for each other: their copies are dealt out evenly, the
    first by text getting what is left over. Other columns pass through, columns called ``_mix...`` are dropped.
    """
    plain = [c for c in docs.columns if not c.startswith("_mix")]
    key = lambda size: F.md5(F.to_json(F.struct("doc_id", "source", size.alias("size"))).cast("binary"))
    taken = mix_sources(docs, weights, budget, epochs).select(key(F.col("size")).alias("_mix_key"), "copies")
    taken = taken.groupBy("_mix_key").agg(F.sum("copies").alias("_mix_copies"), F.count(F.lit(1)).alias("_mix_rows")).filter("_mix_copies > 0")
    place = F.row_number().over(Window.partitionBy("_mix_key").orderBy("text"))
    rows = docs.select(*plain, key(word_count(F.col("text"))).alias("_mix_key")).join(taken, "_mix_key")
    each = F.expr("_mix_copies div _mix_rows") + (F.col("_mix_place") <= F.col("_mix_copies") % F.col("_mix_rows")).cast("int")
    dealt = rows.withColumn("_mix_place", place).withColumn("_mix_times", each).filter("_mix_times > 0")
    return dealt.select(*plain, F.explode(F.sequence(F.lit(1), F.col("_mix_times").cast("int"))).alias("_mix_copy")).drop("_mix_copy")
