"""Licence texts and notices anywhere in a text: windows of words against templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberline.llm.licenses import MIN_DICE, TEMPLATES

#: The headers that licences ask for at the start of a file.
HEADERS = {
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
        "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License."
    ),
} | {
    f"{name}-header": (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software "
        f"Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        f"useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."
    )
    for name, kind, version in (
        ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"),
        ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3"),
    )
}

_WORD = re.compile(rb"[a-z0-9]+")
#: ASCII letters in lower case and digits stay, any other byte is a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def all_templates() -> dict[str, str]:
    """The notices of ``licenses.TEMPLATES``, HEADERS, and the licence texts of the folder ``license_texts`` as ``name-text``."""
    folder = resources.files("emberline.llm").joinpath("license_texts")
    texts = {f"{f.name.removesuffix('.txt')}-text": f.read_text("utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}
    return TEMPLATES | HEADERS | dict(sorted(texts.items()))


class Windows:
    """Templates prepared for ``find``; small enough to go to every task."""

    def __init__(self, templates: Mapping[str, str], min_dice: float):
        words = {name: text.encode().translate(_FOLD).split() for name, text in sorted(templates.items())}
        words = {name: w for name, w in words.items() if len(w) > 1}
        if not words:
            raise ValueError("no template has two words")
        self.names, self.min_dice = list(words), min_dice
        self.known = {w: i for i, w in enumerate(sorted({w for one in words.values() for w in one}))}
        codes = []
        for one in words.values():
            at = np.array([self.known[w] for w in one], np.int64)
            codes.append(at[:-1] * len(self.known) + at[1:])
        self.pairs = np.unique(np.concatenate(codes))
        self.has = np.zeros((len(words), len(self.pairs)), bool)
        for k, one in enumerate(codes):
            self.has[k, np.searchsorted(self.pairs, one)] = True
        self.sizes = self.has.sum(axis=1)
        # a window reaches min_dice only with so many of the pairs, and with so many pairs at most
        share = min_dice / (2 - min_dice)
        self.least = np.ceil(share * self.sizes - 1e-9).astype(int)
        self.spans = np.array([int(len(one) / share) for one in codes])

    def find(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """(template, coefficient, first word, last word) of the best windows that do not overlap, best first."""
        words = text.translate(_FOLD).split()
        if len(words) < 2:
            return []
        known = self.known
        ids = np.array([known.get(w, -1) for w in words], np.int64)
        code = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * len(known) + ids[1:], -1)
        place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        place = np.where(self.pairs[place] == code, place, -1)
        present = np.unique(place[place >= 0])
        near = np.flatnonzero(self.has[:, present].sum(axis=1) >= self.least) if len(present) else []
        if not len(near):
            return []
        # where each pair, of any words, stood before
        numbers = {}
        every = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        every = every[:-1] * len(numbers) + every[1:]
        order = np.argsort(every, kind="stable")
        before = np.full(len(every), -1)
        same = every[order[1:]] == every[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        found = []
        for k in near:
            hit = (place >= 0) & self.has[k][place]
            size, span, least = self.sizes[k], self.spans[k], self.least[k]
            total = np.concatenate([[0], np.cumsum(hit)])
            starts = np.flatnonzero(hit)
            starts = starts[total[np.minimum(starts + span, len(hit))] - total[starts] >= least]
            for start in starts.tolist():
                new = before[start : start + span] < start
                shared = np.cumsum(new & hit[start : start + span])
                if shared[-1] < least:
                    continue
                dice = 2.0 * shared / (np.cumsum(new) + size)
                end = int(np.argmax(dice))
                if dice[end] >= self.min_dice:
                    found.append((-float(dice[end] * shared[end]), start, start + end + 1, self.names[k], float(dice[end])))
        taken, out = np.zeros(len(words), bool), []
        for _, first, last, name, dice in sorted(found):
            if not taken[first : last + 1].any():
                taken[first : last + 1] = True
                out.append((name, dice, first, last))
        return out


def scan_license_texts(docs: DataFrame, templates: Mapping[str, str] | None = None, min_dice: float = MIN_DICE) -> DataFrame:
    """``doc_id``, ``license`` (of the best window, null if none), ``dice``, ``line`` and ``last_line`` (where it begins and ends, from 0),
    ``n_notices`` and ``licenses`` (the distinct templates found, sorted): one row per row of ``docs`` (``doc_id``, ``text``).

    Words are runs of ASCII letters and digits in lower case; line ends are spaces. For each word that begins a shared pair, the best
    window of at most a template's pairs times (2 - t) / t is a hit if its coefficient is at least ``min_dice``. Hits are taken by shared
    pairs times coefficient, then place, then name, and drop those that overlap one taken before; the first is the best.
    Windows are compared in the row, nothing is shuffled or joined. A null text, or one of fewer than two words, has no notice;
    repeated rows give repeated results; other columns are ignored.
    """
    windows = Windows(all_templates() if templates is None else templates, min_dice)
    rows = docs.select("doc_id", docs["text"].cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    types = [("license", pa.string()), ("dice", pa.float64()), ("line", pa.int64()), ("last_line", pa.int64()), ("n_notices", pa.int64()), ("licenses", pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                data = text.as_py() or b""
                hits = windows.find(data)
                if not hits:
                    out.append((None, None, None, None, 0, []))
                    continue
                name, dice, first, last = hits[0]
                ends = [m.span() for k, m in enumerate(_WORD.finditer(data.translate(_FOLD))) if k in (first, last)]
                line, last_line = data.count(b"\n", 0, ends[0][0]), data.count(b"\n", 0, ends[-1][0])
                out.append((name, dice, line, last_line, len(hits), sorted({h[0] for h in hits})))
            columns = zip(*out, strict=True) if out else [()] * len(types)
            arrays = [pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *(n for n, _ in types)])

    return rows.mapInArrow(run, f"doc_id {kind}, license string, dice double, line long, last_line long, n_notices long, licenses array<string>")
