"""Suffix-array dedup: bytes covered by long strings that start more than once in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.anchors import anchors
from emberline.session import materialize

#: Length in bytes of the strings whose repetition counts; a multiple of eight, as suffixes are read eight bytes at a time.
LENGTH = 400
#: Bytes of an anchor. Two suffixes are compared only if their first LENGTH bytes have the same anchor.
GRAM = 128
#: Bytes of blocks for each range of suffixes, so that a bucket fits in a task whatever the size of the corpus; and about what
#: a block holds: the starts of one anchor, LENGTH bytes from the last of them, and a gram before.
RANGE_BYTES, BLOCK_BYTES = 16 << 20, 700
#: Leading bytes of a suffix that the ranges go by; the splitters that Spark samples are no longer than that.
LEAD = 192
#: Suffixes sorted at a time within a bucket.
SUFFIXES = 400_000

BLOCK = pa.schema([
    ("key", pa.int64()), ("size", pa.int64()), ("anchor", pa.int64()), ("start", pa.int64()),
    ("before", pa.binary()), ("suffix", pa.binary()), ("firsts", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())),
])
BLOCK_DDL = "key long, size long, anchor long, start long, before binary, suffix binary, firsts array<long>, places array<long>"
FOUND = pa.schema([("key", pa.int64()), ("size", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
FOUND_DDL = "key long, size long, first long, last long"
SORTED = pa.schema([*FOUND, ("shard", pa.int64()), ("border", pa.binary())])
SORTED_DDL = f"{FOUND_DDL}, shard long, border binary"
#: A string at a border: its digest, and the text and the place where it starts.
BORDER = np.dtype([("a", "<u8"), ("b", "<u8"), ("key", "<i8"), ("size", "<i8"), ("place", "<i8")])


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """A row per text and distinct anchor; ``many`` if it stands in the text more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, found, many = [], [], []
                for k, text in enumerate(part.column(3)):
                    hashes = anchors(np.frombuffer(text.as_py(), np.uint8), LENGTH, GRAM)[0]
                    distinct, counts = np.unique(hashes, return_counts=True)
                    rows.append(np.full(len(distinct), k))
                    found.append(distinct)
                    many.append(counts > 1)
                take = pa.array(np.concatenate(rows))
                columns = [part.column(c).take(take) for c in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(many))],
                    names=["key", "size", "doc_id", "anchor", "many"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("key", "size", "doc_id", "text").mapInArrow(run, f"key long, size long, doc_id {kind}, anchor long, many boolean")


def _blocks(texts: DataFrame) -> DataFrame:
    """Cut out what the suffixes at the ``wanted`` anchors of each text need: LENGTH bytes from each start.

    Neighbouring runs of starts whose anchors are equal and overlap, as in text that repeats one word, are one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for key, size, text, wanted in zip(*(batch.column(c) for c in range(4)), strict=True):
                data = text.as_py()
                hashes, places, firsts, lasts = anchors(np.frombuffer(data, np.uint8), LENGTH, GRAM)
                signed = hashes.view(np.int64)
                hit = np.isin(signed, np.asarray(wanted.as_py(), np.int64))
                cut = np.concatenate([[True], (signed[1:] != signed[:-1]) | (hit[1:] != hit[:-1]) | (np.diff(places) >= GRAM)]) if len(hit) else hit
                edges = np.append(np.flatnonzero(cut), len(hit))
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    if hit[i]:
                        start, stop = int(firsts[i]), int(lasts[j - 1]) + LENGTH
                        at = int(places[i])
                        rows.append((key.as_py(), size.as_py(), int(signed[i]), start, data[start:at], data[at:stop], (firsts[i:j] - start).tolist(), (places[i:j] - start).tolist()))
                        held += stop - start + 16 * int(j - i)
                if held > 4 << 20:
                    yield _batch(rows, BLOCK)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, BLOCK)

    return texts.select("key", "size", "text", "wanted").mapInArrow(run, BLOCK_DDL)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _words(data: bytes) -> np.ndarray:
    """The eight bytes from each place, as a number that sorts like them."""
    padded = data + bytes(16)
    out = np.empty(len(data) + 8, np.uint64)
    for k in range(8):
        row = np.frombuffer(padded, ">u8", (len(padded) - k) // 8, k)
        part = out[k::8]
        part[:] = row[: len(part)]
    return out


def equal_suffixes(words: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the suffixes that start at ``at`` agree in their first LENGTH bytes with another of their ``group``.

    Multikey quicksort with eight bytes as a character, all open segments one step at a time: a segment is parted into
    smaller, equal and larger by the character of its middle suffix; the equal part goes on with the next character.
    Segments of one suffix are done. Returns the numbers of the suffixes in segments that stayed together, segment by
    segment, and the number of the segment of each.
    """
    order = np.argsort(group, kind="stable")
    change = np.flatnonzero(np.diff(group[order])) + 1
    starts = np.concatenate([[0], change]) if len(order) else change
    sizes = np.diff(np.append(starts, len(order)))
    depth = np.zeros(len(starts), np.int64)
    done: list[np.ndarray] = []
    done_sizes: list[np.ndarray] = []
    while len(starts):
        open_ = sizes > 1
        if not open_.all():
            order, sizes, depth = order[np.repeat(open_, sizes)], sizes[open_], depth[open_]
        full = depth == LENGTH // 8
        if full.any():
            inside = np.repeat(full, sizes)
            done.append(order[inside])
            done_sizes.append(sizes[full])
            order, sizes, depth = order[~inside], sizes[~full], depth[~full]
        if not len(sizes):
            break
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        segment = np.repeat(np.arange(len(sizes)), sizes)
        character = words[at[order] + 8 * depth[segment]]
        pivot = character[starts + sizes // 2][segment]
        place = 3 * segment + 1 + (character > pivot).astype(np.int64) - (character < pivot)
        counts = np.bincount(place, minlength=3 * len(sizes))
        if len(counts) > 3 * len(sizes) or (counts[1::3] != sizes).any():
            order = order[np.argsort(place, kind="stable")]
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()
        sizes = counts
        starts = np.zeros(len(sizes), np.int64)
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    each = np.concatenate(done_sizes)
    return np.concatenate(done), np.repeat(np.arange(len(each)), each)


def _bucket(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Sort the suffixes of one range; see ``repeated_starts`` for what comes out."""
    table = pa.Table.from_batches(list(batches), BLOCK)
    if not table.num_rows:
        return
    table = table.take(pa.array(np.argsort(table.column("anchor").to_numpy(), kind="stable")))
    anchor = table.column("anchor").to_numpy()
    before, suffix = (table.column(c).to_pylist() for c in ("before", "suffix"))
    border = _border(suffix)
    sizes = np.array([len(b) + len(s) for b, s in zip(before, suffix, strict=True)])
    number = sizes - LENGTH + 1  # suffixes of a block
    firsts, places = (table.column(c).to_pylist() for c in ("firsts", "places"))
    key, size, start = (table.column(c).to_numpy() for c in ("key", "size", "start"))
    groups = np.append(np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1]), len(anchor))
    lo, outside = 0, []
    while lo < len(groups) - 1:
        hi = lo + 1
        total = number[groups[lo] : groups[hi]].sum()
        while hi < len(groups) - 1 and total + (more := number[groups[hi] : groups[hi + 1]].sum()) <= SUFFIXES:
            total, hi = total + more, hi + 1
        own = slice(groups[lo], groups[hi])
        lo = hi
        data = b"".join(b + s for b, s in zip(before[own], suffix[own], strict=True))
        words, offset = _words(data), np.concatenate([[0], np.cumsum(sizes[own])])
        count = number[own]
        block = np.repeat(np.arange(len(count)), count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        distance = np.concatenate([np.repeat(p, np.diff(np.append(f, n))) for f, p, n in zip(firsts[own], places[own], count, strict=True)]) - inside
        at = offset[block] + inside
        group = np.unique(anchor[own], return_inverse=True)[1][block] * LENGTH + distance
        repeated = np.zeros(len(at), bool)
        heads = [np.zeros(0, np.int64)]
        edge = LENGTH - distance <= border[own][block]
        for part in _parts(group):
            same, segment = equal_suffixes(words, at[part], group[part])
            same = part[same]
            repeated[same] = True
            if edge[part].any():
                alone = edge[part].copy()
                alone[np.isin(part, same)] = False
                lead = same[np.concatenate([[True], segment[1:] != segment[:-1]])] if len(same) else same
                heads += [part[alone], lead[edge[lead]]]
        hit = np.flatnonzero(repeated)
        if len(hit):
            cut = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(block[hit]) > 0)])
            first, last = hit[cut], hit[np.append(np.flatnonzero(cut)[1:] - 1, len(hit) - 1)]
            b = block[first] + own.start
            runs = [pa.array(x) for x in (key[b], size[b], start[b] + inside[first], start[b] + inside[last])]
            yield pa.RecordBatch.from_arrays([*runs, pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.binary())], schema=SORTED)
        given = np.concatenate(heads)
        if len(given):
            rows, b = np.empty(len(given), BORDER), block[given] + own.start
            digests = b"".join(hashlib.blake2b(data[at[i] : at[i] + LENGTH], digest_size=16).digest() for i in given)
            rows["a"], rows["b"] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
            rows["key"], rows["size"], rows["place"] = key[b], size[b], start[b] + inside[given]
            outside.append(rows)
    if outside:
        rows = np.concatenate(outside)
        shard = (rows["a"] % np.uint64(shards)).astype(np.int64)
        rows, shard = rows[order := np.argsort(shard, kind="stable")], shard[order]
        cuts = np.append(np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1]), len(shard))
        packed = [rows[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        empty = [pa.nulls(len(packed), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*empty, pa.array(shard[cuts[:-1]]), pa.array(packed, pa.binary())], schema=SORTED)


def _across(table: pa.Table) -> pa.Table:
    """Of the strings of one shard those that two buckets give."""
    rows = np.concatenate([np.frombuffer(b.as_buffer(), BORDER) for b in table.column("border")])
    rows = rows[np.lexsort((rows["b"], rows["a"]))]
    same = (rows["a"][1:] == rows["a"][:-1]) & (rows["b"][1:] == rows["b"][:-1])
    rows = rows[np.append(same, False) | np.append(False, same)]
    return pa.Table.from_arrays([pa.array(rows[c]) for c in ("key", "size", "place", "place")], schema=FOUND)


def _border(suffix: list[bytes]) -> np.ndarray:
    """How many bytes of each suffix another bucket may hold too, 0 if fewer than an anchor.

    Suffixes that begin alike are neighbours in the order of the ranges, so a beginning that goes on in another bucket is also
    one of the first or last suffix of this one; those that agree in all LEAD bytes lie in any order. An anchor that overlaps itself may stand in a block at another
    place than the one the block is sorted by; under it any string may be elsewhere.
    """
    common = np.zeros(len(suffix), np.int64)
    for end in {min(suffix), max(suffix)}:
        lead = end[:GRAM]
        overlaps = any(lead[p:] == lead[:-p] for p in range(1, GRAM))
        edge = np.frombuffer(end, np.uint8)
        for k, one in enumerate(suffix):
            if one.startswith(lead):
                n = min(len(one), len(end))
                differ = np.frombuffer(one, np.uint8, n) != edge[:n]
                first = int(differ.argmax()) if differ.any() else n
                common[k] = max(common[k], LENGTH if overlaps or first >= LEAD else first)
    return common


def _parts(group: np.ndarray) -> Iterator[np.ndarray]:
    """Places of whole groups, in portions of about SUFFIXES places."""
    if len(group) <= SUFFIXES:
        yield np.arange(len(group))
        return
    order = np.argsort(group, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(group[order])) + 1, len(order))
    lo = 0
    while lo < len(order):
        k = np.searchsorted(ends, lo + SUFFIXES, side="right")
        hi = ends[k - 1] if k and ends[k - 1] > lo else ends[k]
        yield order[lo:hi]
        lo = hi


def repeated_starts(docs: DataFrame) -> DataFrame:
    """``key``, ``size``, ``first``, ``last``: runs of places of a text at which a string of LENGTH bytes starts that also starts elsewhere.

    Every string of LENGTH bytes has an anchor, the GRAM bytes in it with the smallest hash, so that equal strings have equal
    anchors at equal distances. Only strings whose anchor occurs twice are looked at. Their suffixes are range-partitioned by
    the bytes from the anchor on; Spark samples the splitters. A bucket sorts its suffixes by multikey quicksort and marks
    neighbours that agree in LENGTH bytes. A passage that many texts share is spread over several buckets; of the strings
    that begin like the first or last suffix of a bucket, and so may stand in the next one, each bucket gives every
    distinct one once. They travel as digests, packed into a row for each bucket and shard of digests; strings that two
    buckets give are repeated too.
    """
    found = materialize(_anchor_rows(docs), "suffix-anchors")
    repeated = found.groupBy("anchor").agg(F.min(F.struct("key", "size")).alias("a"), F.max(F.struct("key", "size")).alias("b"), F.max("many").alias("many"))
    # stored, as the next table is, so that the joins are free of the aggregations and Spark can split hot anchors and texts
    repeated = materialize(repeated.filter("many OR a != b").select("anchor"), "suffix-repeated")
    wanted = found.join(repeated, "anchor").groupBy("key", "size").agg(F.collect_set("anchor").alias("wanted"), F.min("doc_id").alias("_first"))
    wanted = materialize(wanted, "suffix-wanted")
    # of texts that are equal one is cut; the others are judged by their number
    texts = docs.join(wanted, ["key", "size"]).filter(F.col("doc_id").eqNullSafe(F.col("_first")))
    blocks = wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks * BLOCK_BYTES // RANGE_BYTES))
    buckets = _blocks(texts).repartitionByRange(ranges, F.substring("suffix", 1, LEAD), "key", "start")
    done = materialize(buckets.mapInArrow(lambda batches: _bucket(batches, ranges), SORTED_DDL), "suffix-buckets")
    across = done.filter("border IS NOT NULL").select("shard", "border").groupBy("shard").applyInArrow(_across, FOUND_DDL)
    return done.filter("border IS NULL").drop("shard", "border").unionByName(across)


def cut_spans(text: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes that no string of LENGTH bytes from the given starts covers, the number of the others, and their runs."""
    kept, at, spans, removed = [], 0, 0, 0
    end = -1
    for first, last in sorted(runs):
        stop = last + LENGTH
        if first > end:
            kept.append(text[at:first])
            spans += 1
            removed += stop - first
        elif stop > end:
            removed += stop - end
        end = at = max(end, stop)
    kept.append(text[at:])
    return b"".join(kept), removed, spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the remaining bytes) per row of ``docs`` (``doc_id``, ``text``).

    Each byte covered by a string of LENGTH bytes that also starts anywhere else, in this row or another, is removed; strings
    are judged on the input, matches never cross rows. A null text is empty; repeated rows are copies of each other like
    any equal texts; a null ``doc_id`` is a value like others; other columns are ignored; an empty table gives an empty result.
    Texts are known by their hash and length; those that stand in two rows are removed whole without being sorted.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    texts = texts.select("doc_id", "text", F.xxhash64("text").alias("key"), F.octet_length("text").cast("long").alias("size"))
    counts = materialize(texts.select("key", "size").groupBy("key", "size").agg(F.count(F.lit(1)).alias("copies")), "suffix-texts")
    runs = repeated_starts(texts.filter(F.col("size") >= LENGTH))
    each = runs.groupBy("key", "size").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    whole = counts.filter((F.col("copies") > 1) & (F.col("size") >= LENGTH)).select("key", "size", F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("size") - LENGTH).alias("last"))).alias("runs"))
    marks = each.join(whole.select("key", "size"), ["key", "size"], "left_anti").unionByName(whole)
    marked = texts.join(marks, ["key", "size"], "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_py()
                kept, removed, spans = cut_spans(data, [(r["first"], r["last"]) for r in found.as_py() or ()])
                out.append((len(data), removed, spans, kept))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
