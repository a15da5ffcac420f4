"""Ranked lexical search: an inverted index in shards, searched by Block-Max MaxScore, one heap a shard and item."""

from __future__ import annotations

import re
import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.session import broadcast_if_small, materialize

#: A term: a run of ASCII letters, digits and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents returned for each item.
TOP = 50
#: A shard holds about so many bytes of text; a longer text is a shard of its own.
SHARD_BYTES = 16 << 20
#: Postings of a block.
BLOCK = 128
#: Documents of a shard that are looked at before the threshold is raised.
WINDOW = 2048
#: Items that meet a shard in one group.
ITEMS = 512
#: Rows of an index sent from a task at a time.
ROWS = 50_000

# in UTF-8 every byte of a character beyond ASCII is above 0x7F
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")
_INDEX = [("no", pa.int32()), ("last", pa.int32()), ("size", pa.int32()), ("tfs", pa.list_(pa.int64())), ("shortest", pa.list_(pa.int64())), ("data", pa.binary())]


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text, A-Z in lower case, in order, with repeats."""
    return _TERM.findall(text.lower()) if text else []


def pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits each, the lowest first, the high bit set in all but a number's last; and where each begins."""
    sizes = np.ones(len(numbers), np.int64)
    for bits in (7, 14, 21, 28):
        sizes += numbers >= 1 << bits
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(starts[-1], np.uint8)
    for k in range(5):
        more = sizes > k
        out[starts[:-1][more] + k] = (numbers[more] >> (7 * k)) & 127 | np.where(sizes[more] > k + 1, 128, 0)
    return out, starts


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    begins = np.flatnonzero(np.append(True, raw[:-1] < 128))
    place = np.arange(len(raw)) - np.repeat(begins, np.diff(np.append(begins, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), begins)


class _Shard:
    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.ids, self.found = [], []
        self.terms: defaultdict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__

    def add(self, doc_id, text: bytes | None) -> None:
        self.ids.append(doc_id)
        self.found.append(np.fromiter(map(self.terms.__getitem__, terms_of(text)), np.int32))
        self.bytes += len(text or b"") + 64

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        ids, found = [self.ids[k] for k in order], [self.found[k] for k in order]
        lens = np.array([len(x) for x in found], np.int64)
        self.ids, self.found = [], []
        base = {"shard": [self.number], "doc_ids": [ids], "lens": [lens.tolist()], "n_docs": [int((lens > 0).sum())], "n_terms": [int(lens.sum())]}
        yield _rows(1, base, schema)
        if lens.sum():
            keys = np.concatenate(found).astype(np.int64) << 32 | np.repeat(np.arange(len(lens)), lens)
            keys, tf = np.unique(keys, return_counts=True)
            yield from self._postings(keys >> 32, keys & 0xFFFFFFFF, tf, lens, schema)

    def _postings(self, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, lens: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        n = len(term)
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        starts = np.flatnonzero(place % BLOCK == 0)
        stops = np.append(starts[1:], n)
        gap = np.append(doc[:1], np.diff(doc))
        gap[starts] = doc[starts]
        data, offsets = pack(np.stack([gap, tf], axis=1).ravel())
        offsets = offsets[2 * np.append(starts, n)]
        block = np.repeat(np.arange(len(starts)), stops - starts)
        length = lens[doc]
        order = np.lexsort((length, tf, block))
        b, f = block[order], tf[order]
        kept = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (f[1:] != f[:-1])))
        bounds = np.searchsorted(b[kept], np.arange(len(starts) + 1))
        tfs, shortest = f[kept], length[order][kept]
        names = pa.array(list(self.terms), pa.binary())
        for a in range(0, len(starts), ROWS):
            z = min(a + ROWS, len(starts))
            lists = pa.array(bounds[a : z + 1] - bounds[a], pa.int32())
            inside = slice(bounds[a], bounds[z])
            raw = data[offsets[a] : offsets[z]].tobytes()
            columns = {
                "shard": np.full(z - a, self.number), "term": names.take(pa.array(term[starts[a:z]])), "no": place[starts[a:z]] // BLOCK,
                "last": doc[stops[a:z] - 1], "size": stops[a:z] - starts[a:z],
                "tfs": pa.ListArray.from_arrays(lists, pa.array(tfs[inside])), "shortest": pa.ListArray.from_arrays(lists, pa.array(shortest[inside])),
                "data": pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer((offsets[a : z + 1] - offsets[a]).astype(np.int32).tobytes()), pa.py_buffer(raw)]),
            }
            yield _rows(z - a, columns, schema)


def _rows(n: int, columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    def column(f):
        value = columns.get(f.name)
        return pa.nulls(n, f.type) if value is None else value if isinstance(value, pa.Array) else pa.array(value, f.type)

    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


def build_index(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (``doc_id``, ``text``), in shards that are built within the task that reads their texts.

    A row with a null ``term`` lists the documents of a shard in the order of their ids, with the number of their terms. Every other row
    is a block of up to BLOCK postings of a term: the number ``no`` of the block, its ``last`` document, its ``size``, the
    packed postings, and for each frequency ``tfs`` in it the ``shortest`` document. The last two give the
    exact maximum of a block whatever the statistics of the corpus are, so shards need no second pass and can be added later.
    """
    picked = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    ddl = (
        f"shard long, doc_ids array<{kind}>, lens array<long>, n_docs long, n_terms long, "
        "term binary, no int, last int, size int, tfs array<long>, shortest array<long>, data binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, shard, number = None, None, TaskContext.get().partitionId() << 32
        for batch in batches:
            if schema is None:
                ids = pa.list_(batch.schema.field(0).type)
                schema = pa.schema([("shard", pa.int64()), ("doc_ids", ids), ("lens", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("term", pa.binary()), *_INDEX])
            for doc_id, text in zip(*batch.columns, strict=True):
                shard = shard or _Shard(number)
                shard.add(doc_id.as_py(), text.as_py())
                if shard.bytes >= SHARD_BYTES:
                    yield from shard.rows(schema)
                    shard, number = None, number + 1
        if shard:
            yield from shard.rows(schema)

    return picked.mapInArrow(run, ddl)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def length_factor(lens: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 50 + 50 * n * N div L of each length, in whole numbers of any size."""
    known, place = np.unique(lens, return_inverse=True)
    return np.array([50 + 50 * n * documents // total for n in known.tolist()], np.int64)[place]


class _List:
    """The postings of a term in a shard; blocks are unpacked when first asked for."""

    def __init__(self, weight: int, last: list[int], maxima: list[int], data: list[bytes], m: np.ndarray):
        self.last, self.data, self.m = np.array(last), data, m
        self.maxima = weight * np.array(maxima)
        self.bound, self.weight = int(self.maxima.max()), weight
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and their scores."""
        if number not in self.known:
            values = unpack(self.data[number])
            docs, tf = np.cumsum(values[::2]), values[1::2]
            self.known[number] = docs, self.weight * impact(tf, self.m[docs])
        return self.known[number]

    def add_all(self, scores: np.ndarray, low: int) -> None:
        """Add the scores of the documents from ``low`` on, as many as ``scores`` has places."""
        high = low + len(scores)
        for number in range(int(np.searchsorted(self.last, low)), len(self.last)):
            docs, points = self.block(number)
            a, z = np.searchsorted(docs, (low, high))
            scores[docs[a:z] - low] += points[a:z]
            if self.last[number] >= high:
                break


def search_shard(lists: list[_List], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best documents of a shard (smaller numbers first among equals) and their scores, above 0 only.

    Lists are ordered by their bound. Those whose bounds together cannot lift a document over the threshold are not essential: they are
    asked only for documents that an essential list has named, and only where the maximum of the block can still
    lift them over it; other blocks stay packed. Documents come in ascending order, so an equal score never replaces one.
    """
    lists = sorted(lists, key=lambda x: x.bound)
    sums = np.cumsum([0, *(x.bound for x in lists)])
    best, points = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for low in range(0, n_docs, WINDOW):
        floor = int(points[-1]) if len(points) == k else 0
        first = int(np.searchsorted(sums[1:], floor, side="right"))
        if first == len(lists):
            break
        scores = np.zeros(min(WINDOW, n_docs - low), np.int64)
        for one in lists[first:]:
            one.add_all(scores, low)
        docs = np.flatnonzero(scores)
        docs = docs[scores[docs] + sums[first] > floor]
        for i in range(first - 1, -1, -1):
            one = lists[i]
            number = np.searchsorted(one.last, docs + low)
            ahead = np.append(one.maxima, 0)[number]
            near = scores[docs] + ahead + sums[i] > floor
            docs, number = docs[near], number[near]
            for b in np.unique(number[number < len(one.last)]):
                here = docs[number == b]
                held, gain = one.block(int(b))
                at = np.minimum(np.searchsorted(held, here + low), len(held) - 1)
                scores[here] += np.where(held[at] == here + low, gain[at], 0)
            docs = docs[scores[docs] + sums[i] > floor]
            if not len(docs):
                break
        best, points = np.append(best, docs + low), np.append(points, scores[docs])
        order = np.lexsort((best, -points))[:k]
        best, points = best[order], points[order]
    return best, points


def search(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: the ``k`` best documents of ``index`` for each row of ``items`` (``item_id``, ``text``).

    With N documents that hold a term, L terms in all, n in a document, df documents with a term and tf of it in a document, a term weighs
    floor(1000 ln((2N + 2) / (2df + 1))) and adds its weight times 10^9 tf div (1000 tf + 20 (50 + 50 n N div L)), once for each
    item however often it stands in the item. Only scores above 0 count; equal scores go by ascending ``doc_id``, a null one last.

    The blocks of the items' terms are joined with the items that ask for them, ITEMS items at a time, and each shard
    searches its own blocks; the heaps of the shards are merged by a limit within each item before and after the
    shuffle. Every row of ``items`` has its own ranks, also if ids repeat; a null or empty text has none, as has an empty index.
    Repeated documents are ranked each. Other columns are ignored.
    """
    alphabet = string.ascii_uppercase
    lower = F.translate("text", alphabet, alphabet.lower())
    asked = materialize(items.select("item_id", F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("terms"), F.monotonically_increasing_id().alias("item")), "lexical-items")
    groups = max(1, -(-asked.count() // ITEMS))
    wanted = asked.select("item", F.pmod(F.xxhash64("item"), F.lit(groups)).alias("part"), F.explode("terms").alias("word")).select("item", "part", F.col("word").cast("binary").alias("term"))
    wanted = materialize(wanted, "lexical-wanted")
    distinct = materialize(wanted.select("term").distinct(), "lexical-terms")
    blocks = index.filter(F.col("term").isNotNull()).select("shard", "term", "no", "last", "size", "tfs", "shortest", "data")
    hits = materialize(blocks.join(broadcast_if_small(distinct, 256, 64 << 20), "term"), "lexical-hits")
    shards = index.filter(F.col("term").isNull()).select("shard", "doc_ids", "lens", "n_docs", "n_terms")
    size = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    documents, total = int(size["n"]), int(size["l"])
    share = (F.lit(2.0) * documents + 2.0) / (2.0 * F.col("df") + 1.0)
    weights = hits.groupBy("term").agg(F.sum("size").cast("double").alias("df")).select("term", F.floor(1000 * F.log(share)).alias("weight"))
    asks = wanted.groupBy("part", "term").agg(F.collect_list("item").alias("items")).join(weights, "term")
    asks = materialize(asks.filter("weight > 0"), "lexical-asks")
    # the items of a row fit in 4 kB and a word
    tasks = hits.join(broadcast_if_small(asks, 8 * ITEMS + 256, 64 << 20), "term").withColumnRenamed("shard", "of").withColumnRenamed("part", "group")
    sides = shards.filter("n_docs > 0").select("shard", "doc_ids", "lens", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"))
    kind = dict(index.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids_type = left.column("doc_ids").type.value_type if left.num_columns else pa.int64()
        out = {"item": [np.zeros(0, np.int64)], "place": [np.zeros(0, np.int64)], "score": [np.zeros(0, np.int64)]}
        ids = []
        if left.num_rows and right.num_rows:
            ids = left.column("doc_ids")[0].as_py()
            m = length_factor(left.column("lens")[0].values.to_numpy(), documents, total)
            of_item = _lists(right, m, documents, total)
            for item, lists in of_item.items():
                best, points = search_shard(lists, len(m), k)
                out["item"].append(np.full(len(best), item))
                out["place"].append(best)
                out["score"].append(points)
        item, place, score = (np.concatenate(x) for x in out.values())
        return pa.Table.from_arrays([pa.array(item), pa.array([ids[p] for p in place.tolist()], ids_type), pa.array(score)], names=["item", "doc_id", "score"])

    heaps = sides.groupBy("shard", "part").cogroup(tasks.groupBy("of", "group")).applyInArrow(run, f"item long, doc_id {kind}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = asked.select("item", "item_id")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``search`` over an index of ``docs`` that is built and written first."""
    return search(materialize(build_index(docs), "lexical-index"), items, k)


def _lists(rows: pa.Table, m: np.ndarray, documents: int, total: int) -> dict[int, list[_List]]:
    """The lists of each item, from the blocks of one shard."""
    term, no, last, weight = (rows.column(c).to_pylist() for c in ("term", "no", "last", "weight"))
    tfs, shortest = rows.column("tfs").combine_chunks(), rows.column("shortest").combine_chunks()
    most = np.maximum.reduceat(impact(tfs.flatten().to_numpy(), length_factor(shortest.flatten().to_numpy(), documents, total)), np.cumsum([0, *tfs.value_lengths().to_pylist()[:-1]]))
    data, items = rows.column("data"), rows.column("items")
    of_term = defaultdict(list)
    for r, t in enumerate(term):
        of_term[t].append(r)
    out = defaultdict(list)
    for places in of_term.values():
        places.sort(key=no.__getitem__)
        one = _List(weight[places[0]], [last[r] for r in places], [int(most[r]) for r in places], [data[r].as_py() for r in places], m)
        for item in items[places[0]].as_py():
            out[item].append(one)
    return out
