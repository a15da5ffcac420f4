"""Quality rules: text statistics, and a decision list learned from labelled statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import WORD, let
from emberline.session import materialize

#: Words in a window whose repetition counts.
REPEAT_WINDOW = 8
#: A document with fewer words fails the base rule.
MIN_WORDS = 20
#: So does one with more than this percentage of its words in repeated windows.
MAX_REPEAT_PERCENT = 30

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further counts that the learned rules may use.
EXTRA = ("n_distinct_words", "n_upper", "n_marks", "n_digits", "n_lines")

_RATIO = (0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5, 2.0)
#: Feature: numerator, denominator and the thresholds that rules may use.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words", _RATIO),
    "marks_per_word": ("n_marks", "n_words", _RATIO),
    "upper_share": ("n_upper", "word_chars", _RATIO),
    "digit_share": ("n_digits", "word_chars", _RATIO),
    "dup_line_share": ("n_dup_lines", "n_lines", _RATIO),
    "repeat_share": ("n_repeat_words", "n_words", _RATIO),
    "distinct_share": ("n_distinct_words", "n_words", _RATIO),
    "chars_per_word": ("word_chars", "n_words", (2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 7.0, 8.0, 10.0, 12.0, 15.0)),
    "words": ("n_words", None, (30.0, 50.0, 75.0, 100.0, 150.0, 200.0, 300.0, 500.0, 1000.0, 2000.0, 5000.0)),
}
#: A learned rule must reject this share of bad rows among those it meets, on rows it was not grown on,
MIN_PRECISION = 0.9
#: and so many of them.
MIN_COVERED = 3
MAX_RULES = 12
MAX_CONDITIONS = 4


def _repeated_words(words: Column) -> Column:
    """Words covered by a window of ``REPEAT_WINDOW`` words that occurs at least twice; windows compare by hash."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (REPEAT_WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, REPEAT_WINDOW))))

    def covered(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def marked(s: Column) -> Column:
            same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
            return F.filter(
                F.transform(s, lambda x, i: F.when(same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x), x["p"])), lambda p: p.isNotNull()
            )

        start = F.struct(F.lit(0).alias("n"), F.lit(-REPEAT_WINDOW).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(REPEAT_WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(F.sort_array(let(ordered, marked)), start, step)["n"]

    repeated = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))
    return F.when(F.size(words) < REPEAT_WINDOW, F.lit(0)).otherwise(repeated)


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``BASE`` and ``EXTRA``, ``base_failed``, and one struct-free pass over the text.

    A null text counts as empty. Only built-in expressions are used; a document's arrays never leave its row.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    from_words = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        _repeated_words(w).cast("long").alias("n_repeat_words"),
    ))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(WORD))
    from_lines = let(lines, lambda ls: F.struct(
        F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
    ))
    length = lambda c: F.length(c).cast("long")
    without = lambda chars: length(whole) - length(F.translate(whole, chars, ""))
    found = docs.select(
        "*", from_words.alias("_w"), from_lines.alias("_l"),
        length(F.translate(whole, " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        without("#*$%&|<>").alias("n_symbols"), without("!?").alias("n_marks"), without("0123456789").alias("n_digits"),
        F.regexp_count(whole, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    return found.select("*", "_w.*", "_l.*").drop("_w", "_l").withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    )


@dataclass(frozen=True)
class Condition:
    """``feature > threshold`` or ``feature <= threshold``; ``bin`` is the threshold's place in the feature's list."""

    feature: str
    above: bool
    bin: int

    @property
    def threshold(self) -> float:
        return FEATURES[self.feature][2][self.bin]

    def column(self) -> Column:
        return feature(self.feature) > self.threshold if self.above else feature(self.feature) <= self.threshold

    def on_bins(self) -> Column:
        place = F.col("bins")[list(FEATURES).index(self.feature)]
        return place > self.bin if self.above else place <= self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def feature(name: str) -> Column:
    top, bottom, _ = FEATURES[name]
    return F.col(top).cast("double") if bottom is None else F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def _bin(value: Column, grid: Sequence[float]) -> Column:
    """How many of the thresholds lie below ``value``."""
    return F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: value > t))


def _every(conditions: Sequence[Condition], form) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & form(c)
    return out


def _grow(rows: DataFrame) -> Rule:
    """Add the condition of the largest FOIL gain until no row of the other class is left."""
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS:
        counts = (
            rows.filter(_every(rule, Condition.on_bins)).select("bad", F.posexplode("bins").alias("f", "bin"))
            .groupBy("f", "bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        )  # at most one row per feature and bin
        table = {(r["f"], r["bin"]): (r["p"], r["n"]) for r in counts}
        p0, n0 = (sum(v[i] for (f, _), v in table.items() if f == 0) for i in (0, 1))
        if not p0 or not n0:
            break
        gains: list[tuple[float, Condition]] = []
        for f, (name, (_, _, grid)) in enumerate(FEATURES.items()):
            low_p = low_n = 0
            for place in range(len(grid)):
                p, n = table.get((f, place), (0, 0))
                low_p, low_n = low_p + p, low_n + n
                for above, cp, cn in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                    if cp:
                        gains.append((cp * (math.log2(cp / (cp + cn)) - math.log2(p0 / (p0 + n0))), Condition(name, above, place)))
        top = max(gains, key=lambda g: g[0], default=(0.0, None))
        if top[0] <= 0:
            break
        # of thresholds that no row tells apart, the middle one keeps the largest distance to either class
        alike = [c for g, c in gains if abs(g - top[0]) < 1e-9 and (c.feature, c.above) == (top[1].feature, top[1].above)]
        best = alike[len(alike) // 2]
        rule.append(best)
    return tuple(rule)


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The prefix of the rule with the best (p - n) / (p + n) on rows it was not grown on, with its p and n."""
    cuts = range(1, len(rule) + 1)
    met = rows.agg(*(
        F.coalesce(F.sum(F.when(_every(rule[:k], Condition.on_bins), value)), F.lit(0)).alias(f"{name}{k}")
        for k in cuts for name, value in (("p", F.col("bad")), ("n", 1 - F.col("bad")))
    )).first()
    scored = [((met[f"p{k}"] - met[f"n{k}"]) / max(1, met[f"p{k}"] + met[f"n{k}"]), -k) for k in cuts]
    k = -max(scored)[1]
    return rule[:k], met[f"p{k}"], met[f"n{k}"]


def learn_rules(labelled: DataFrame) -> list[Rule]:
    """An ordered list of rejecting rules, learned by sequential covering from statistics with a 0/1 column ``bad``.

    Each rule is a conjunction of thresholds grown on two thirds of the rows and pruned on the rest; the rows it meets
    then leave the table. Every step is one aggregation over all labelled rows that returns a count per feature and
    bin, whose number the thresholds fix. Learning stops at the first rule that is not precise enough, and after MAX_RULES
    rules; a rule has MAX_CONDITIONS conditions at most. Both bound the size of the list, so that it can be read; they leave out no rows.
    """
    bins = [_bin(feature(name), grid) for name, (_, _, grid) in FEATURES.items()]
    rows = materialize(labelled.select(F.col("bad").cast("int").alias("bad"), F.array(*bins).alias("bins"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow")), "quality-labels")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        grown = _grow(rows.filter("grow"))
        if not grown:
            break
        rule, p, n = _prune(rows.filter("NOT grow"), grown)
        if p < MIN_COVERED or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
        rows = rows.filter(~_every(rule, Condition.on_bins))
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """The decision list as one conditional expression over the statistics: true keeps."""
    out = F.when(F.col("base_failed"), F.lit(False))
    for rule in rules:
        out = out.when(_every(rule, Condition.column), F.lit(False))
    return out.otherwise(F.lit(True))


def _judged(docs: DataFrame, labels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Statistics and ``kept`` for every row; the columns ``columns`` of ``docs`` are called ``_in_0``, ``_in_1``, ..."""
    renamed = docs.select("text", F.col("doc_id").alias("_id"), *(F.col(c).alias(f"_in_{i}") for i, c in enumerate(columns)))
    stats = materialize(text_stats(renamed).drop("text"), "quality-stats")
    marks = labels.select("doc_id", "quality").filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = stats.filter("NOT base_failed").select(F.col("_id").alias("doc_id"), *BASE, *EXTRA).join(marks, "doc_id")
    return stats.withColumn("kept", verdict(learn_rules(known.withColumn("bad", 1 - F.col("quality")))))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id`` with the statistics, ``base_failed`` and ``kept``: one row per row of ``docs`` (``doc_id``, ``text``).

    The rules are learned from the documents that ``labels`` (``doc_id``, ``quality`` 0 or 1) covers and that pass the
    base rule; other columns are ignored. A null text is empty and fails the base rule; labels without a quality or a
    document are ignored; repeated labels count as often as they stand; without labels only the base rule judges; an
    empty table gives an empty result. The statistics are written once, so the texts are read once.
    """
    return _judged(docs, labels, ["doc_id"]).select(F.col("_in_0").alias("doc_id"), *BASE, *EXTRA, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with their columns; null and repeated rows as there."""
    judged = _judged(docs, labels, docs.columns)
    return judged.filter("kept").select(*(F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)))
