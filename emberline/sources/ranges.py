"""Text whose records may hold their own separator, read by byte ranges: a file of any size is read by many tasks.

Spark cuts a file into ranges and a range into pieces at a separator. Where a record ends depends on all text before it:
a line end or a brace inside quotes is no border. So each range first sums up what it does to the state of the reader, for every state
it may start in; a window over the ranges of a file, a row each, turns these into the state every range does start in.
Then each range cuts its own records, and only what lies across the borders of ranges is put together afterwards.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from emberline.session import materialize

RANGE = ["_file", "_block"]


def _before(value: Column) -> Column:
    """The sum of ``value`` over the pieces of a range before the current one."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*RANGE).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _earlier() -> WindowSpec:
    """The ranges of a file before the current one."""
    return Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def pieces(spark: SparkSession, path: str, separator: str, glob: str | None = None) -> DataFrame:
    """``value`` (the text between two separators), ``_file``, ``_block`` (start of its byte range) and ``_pos`` (its order in the range)."""
    reader = spark.read.option("lineSep", separator)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_pos")
    )


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def cut_records(marked: DataFrame, separator: str) -> DataFrame:
    """``_file``, ``_block``, ``_pos`` (of its first piece) and ``value`` per record; ``_end`` tells whether a record ends with a piece.

    The pieces of a range are grouped without another shuffle than the one that sorted them. A record that goes over borders is
    put together from its parts, at most two for each range; its place is that of its first part. Pieces after the last end
    of a file are no record.
    """
    number = marked.withColumn("_k", _before(F.col("_end").cast("int")))
    inside = F.array_sort(F.collect_list(F.struct("_pos", "value")))
    parts = number.groupBy(*RANGE, "_k").agg(inside.alias("v"), F.min("_pos").alias("_pos"), F.max("_end").alias("_end"))
    parts = materialize(parts.select(*RANGE, "_k", "_pos", "_end", F.array_join(F.transform("v", lambda p: p["value"]), separator).alias("value")), "ranges")
    border = (F.col("_k") == 0) | ~F.col("_end")
    # no text in this window: two rows a range
    earlier = Window.partitionBy("_file").orderBy("_block", "_k").rowsBetween(Window.unboundedPreceding, -1)
    chains = parts.filter(border).select(*RANGE, "_k", F.coalesce(F.sum(F.col("_end").cast("int")).over(earlier), F.lit(0)).alias("_chain"))
    linked = parts.filter(border).join(materialize(chains, "ranges-borders"), [*RANGE, "_k"]).groupBy("_file", "_chain").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_k", "_pos", "value"))).alias("v"), F.max("_end").alias("_end")
    )
    across = linked.filter("_end").select("_file", F.col("v")[0]["_block"].alias("_block"), F.col("v")[0]["_pos"].alias("_pos"), F.array_join(F.transform("v", lambda p: p["value"]), separator).alias("value"))
    return parts.filter(~border).select("_file", "_block", "_pos", "value").unionByName(across)


def csv_records(spark: SparkSession, path: str, encoding: str = "UTF-8", glob: str | None = None) -> DataFrame:
    """``_file``, ``_block``, ``_pos``, ``value`` and ``_head`` (first of its file) per record of delimited text, line ends in quoted cells included.

    A record ends with a line after which the file has an even number of quotes. Ranges in which every line does, the usual
    case, are passed on as they are; only lines of other ranges are sorted.
    """
    lines = pieces(spark, path, "\n", glob)
    if encoding.upper() != "UTF-8":
        lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))
    lines = lines.withColumn("_odd", occurrences(F.col("value"), '"') % 2)
    ranges = lines.groupBy(*RANGE).agg((F.sum("_odd") % 2).alias("_flip"), F.max("_odd").alias("_any"), F.min("_pos").alias("_first"))
    ranges = materialize(ranges.select(*RANGE, "_any", "_first", (F.coalesce(F.sum("_flip").over(_earlier()), F.lit(0)) % 2).alias("_start")), "csv-ranges")
    known = lines.join(ranges.drop("_first"), RANGE)
    plain = (F.col("_any") == 0) & (F.col("_start") == 0)
    before = _before(F.col("_odd"))
    marked = known.filter(~plain).withColumn("_end", (F.col("_start") + before + F.col("_odd")) % 2 == 0)
    records = known.filter(plain).select("_file", "_block", "_pos", "value").unionByName(cut_records(marked.drop("_any", "_start", "_odd"), "\n"))
    heads = ranges.filter("_block = 0").select("_file", "_block", F.col("_first").alias("_pos"), F.lit(True).alias("_head"))
    records = records.withColumn("value", F.regexp_replace("value", r"\r\z", ""))
    return records.join(heads, ["_file", "_block", "_pos"], "left").withColumn("_head", F.coalesce("_head", F.lit(False)))


def split_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", glob: str | None = None) -> DataFrame:
    """Delimited text with a header and line ends in quoted cells, all columns as text; a file of any size is read by many tasks.

    Cells that hold quotes must be quoted, with quotes doubled. The encoding must keep line ends and quotes as single bytes,
    as UTF-8 and the ISO-8859 family do. Files whose headers differ are refused. A folder without records has no columns.
    """
    records = csv_records(spark, path, encoding, glob)
    # a header for each different one, as refused folders show
    heads = [r["value"] for r in records.filter("_head").select("value").distinct().limit(2).collect()]
    if len(heads) > 1:
        raise ValueError(f"files with different headers under {path}")
    names = next(csv.reader([heads[0]], delimiter=sep)) if heads else []
    layout = ", ".join(f"c{i} string" for i in range(len(names)))
    if not names:
        return records.filter("false").select()
    cells = F.from_csv("value", layout, {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "multiLine": "true"})
    body = records.filter(~F.col("_head") & (F.length("value") > 0)).select(cells.alias("c"))
    return body.select(*[F.col(f"c.c{i}").alias(n or f"_c{i}") for i, n in enumerate(names)])


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """``value``, the JSON text of a feature, per member of ``features`` of the collections under ``path``.

    A piece ends with a closing brace. The quotes in it tell whether it ends inside a string, and so which of its braces count;
    both are known for either start. A member ends where the depth comes back to one. What stands between two members tells
    whether they are in the array ``features``.
    """
    found = pieces(spark, path, "}")
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    found = found.withColumn("_bare", bare).withColumn("_odd", occurrences(F.col("_bare"), '"') % 2)
    strings, head = r'"[^"]*+("|$)', r'^[^"]*+("|$)'
    opens = [occurrences(F.regexp_replace(text, strings, ""), "{") for text in (F.col("_bare"), F.regexp_replace("_bare", head, ""))]
    # the closing brace of the piece counts if it stands outside of strings
    found = found.withColumns({"_out": opens[0] - (1 - F.col("_odd")), "_in": opens[1] - F.col("_odd")}).drop("_bare")
    found = found.withColumn("_before", _before(F.col("_odd")) % 2)
    straight, turned = F.when(F.col("_before") == 0, F.col("_out")).otherwise(F.col("_in")), F.when(F.col("_before") == 0, F.col("_in")).otherwise(F.col("_out"))
    ranges = found.groupBy(*RANGE).agg((F.sum("_odd") % 2).alias("_flip"), F.sum(straight).alias("_if_out"), F.sum(turned).alias("_if_in"))
    ranges = ranges.withColumn("_start", F.coalesce(F.sum("_flip").over(_earlier()), F.lit(0)) % 2)
    change = F.when(F.col("_start") == 0, F.col("_if_out")).otherwise(F.col("_if_in"))
    ranges = materialize(ranges.select(*RANGE, "_start", F.coalesce(F.sum(change).over(_earlier()), F.lit(0)).alias("_level")), "geojson-ranges")
    known = found.join(ranges, RANGE).withColumn("_state", (F.col("_start") + F.col("_before")) % 2)
    known = known.withColumn("_step", F.when(F.col("_state") == 0, F.col("_out")).otherwise(F.col("_in")))
    depth = F.col("_level") + _before(F.col("_step")) + F.col("_step")
    closes = (F.col("_state") + F.col("_odd")) % 2 == 0
    members = materialize(cut_records(known.withColumn("_end", closes & (depth == 1)).select("value", *RANGE, "_pos", "_end"), "}"), "geojson-members")
    # text and strings up to the brace that opens the member; the first member of a file stands after the brace of its collection
    gap = r'(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+'
    lead = F.when((F.col("_block") == 0) & F.col("_first"), F.regexp_extract("value", rf"(?s)^({gap}\{{{gap})", 1)).otherwise(F.regexp_extract("value", rf"(?s)^({gap})", 1))
    starts = members.groupBy("_file").agg(F.min(F.struct("_block", "_pos")).alias("s")).select("_file", "s.*", F.lit(True).alias("_first"))
    members = members.join(starts, ["_file", "_block", "_pos"], "left").withColumn("_first", F.coalesce("_first", F.lit(False)))
    led = members.withColumn("_lead", lead).withColumn("_body", F.concat(F.expr("substring(value, length(_lead) + 1)"), F.lit("}")))
    led = led.withColumn("_turn", F.when(F.col("_lead").rlike(r"^\s*,\s*$"), F.lit(None)).otherwise(F.col("_lead").rlike(r'"features"\s*:\s*\[\s*$')))
    turns = led.groupBy(*RANGE).agg(F.array_sort(F.collect_list(F.when(F.col("_turn").isNotNull(), F.struct("_pos", "_turn")))).alias("_turns"))
    turns = turns.withColumn("_entry", F.last(F.get(F.col("_turns"), F.size("_turns") - 1)["_turn"], ignorenulls=True).over(_earlier()))
    led = led.join(materialize(turns, "geojson-turns"), RANGE)
    own = F.filter("_turns", lambda t: t["_pos"] <= F.col("_pos"))
    inside = F.coalesce(F.get(own, F.size(own) - 1)["_turn"], F.col("_entry"))
    return led.filter(inside).select(F.col("_body").alias("value"))
