"""Licence scans: blocks of a text against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import let

#: A block is a licence notice from this coefficient on.
MIN_DICE = 0.8

#: Usual notices of public licences.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-long": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """ASCII lower case, with every run of other characters than letters, digits and line ends as one space."""
    return F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9\n]+", " ")


def bigrams(block: Column) -> Column:
    """The distinct pairs of neighbouring words of a normalised block."""
    words = F.split(F.trim(block), " +")
    pairs = let(words, lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.array_distinct(pairs)


def template_pairs(text: str) -> list[str]:
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] | None = None, min_dice: float = MIN_DICE) -> DataFrame:
    """``doc_id``, ``license`` (of the best block, null if none), ``dice``, ``line`` (its place from 0) and ``n_notices``
    (blocks that match some template): one row per row of ``docs`` (``doc_id``, ``text``).

    Blocks are the lines of the whole text. A template is a candidate for a block only if their numbers of bigrams allow
    the coefficient: |A| / |B| between t / (2 - t) and its inverse; the templates, sorted by size, are part of the plan,
    and the pairs are built in the row, so nothing is shuffled or joined. Of equal coefficients the smaller line wins, then
    the smaller name. A null or empty text, and a line of fewer than two words, has no notice; repeated rows give repeated
    results; other columns are ignored.
    """
    known = {name: template_pairs(text) for name, text in (templates or TEMPLATES).items()}
    entries = [F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, pairs)).alias("pairs")) for name, pairs in sorted(known.items(), key=lambda e: (len(e[1]), e[0])) if pairs]
    if not entries:
        raise ValueError("no template has two words")
    table = F.array(*entries)
    share = min_dice / (2 - min_dice)
    least, most = share * min(map(len, filter(None, known.values()))), max(map(len, known.values())) / share

    def best(found: Column, line: Column) -> Column:
        size = F.size(found)
        near = F.filter(table, lambda t: (size >= share * F.size(t["pairs"])) & (share * size <= F.size(t["pairs"])))
        scored = F.transform(near, lambda t: F.struct(
            (-2.0 * F.size(F.array_intersect(found, t["pairs"])) / (size + F.size(t["pairs"]))).alias("minus"), line.alias("line"), t["name"].alias("name"),
        ))
        return F.when(size.between(least, most), F.array_min(F.filter(scored, lambda s: s["minus"] <= -min_dice)))

    lines = F.split(normalised(F.coalesce(F.col("text"), F.lit(""))), "\n", -1)
    hits = F.filter(F.transform(lines, lambda block, i: let(bigrams(block), lambda found: best(found, i))), lambda h: h.isNotNull())
    top = let(hits, lambda h: F.struct(F.array_min(h).alias("top"), F.size(h).cast("long").alias("n")))
    scanned = docs.select("doc_id", top.alias("_hit"))
    return scanned.select(
        "doc_id", F.col("_hit.top.name").alias("license"), (-F.col("_hit.top.minus")).alias("dice"),
        F.col("_hit.top.line").cast("long").alias("line"), F.col("_hit.n").alias("n_notices"),
    )
