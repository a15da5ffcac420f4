"""LM scoring: context-tree weighting over the bytes of texts, and the unigram score of their words next to it."""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import WORD
from emberline.session import materialize

#: Bytes of context at most; a context and the byte after it must fit in 56 bits.
DEPTH = 5
#: Ends a text, and stands for the bytes before its first one. No word holds it.
END = b"\n"
#: Texts are gathered and scored in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 32 << 20
#: Bytes of text in a row of a chunk, and positions looked at in one go.
BLOCK_BYTES = 1 << 20
#: Grams and words are counted in parts, one for so many bytes of all texts.
PART_BYTES = 16 << 20
#: Log probabilities are summed as integers of this unit, so that no order of tasks or texts changes a sum.
UNIT = 1 << 24
#: The same for the weights of the tree, in which sums grow with the whole corpus.
TREE_UNIT = 1 << 12

_WORD = re.compile(WORD.encode())


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return _WORD.findall(text.lower()) if text else []


def grams(padded: bytes, sizes: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, gram) of every byte of the texts in ``padded``, in portions; a gram is a byte with the ``depth`` before it.

    ``padded`` holds ``depth`` times END before each text; positions count the bytes of the texts alone.
    """
    data = np.frombuffer(padded, np.uint8)
    real = np.repeat(np.tile([False, True], len(sizes)), np.stack([np.full(len(sizes), depth), sizes], axis=1).ravel())
    done = 0
    for a in range(depth, len(data), BLOCK_BYTES):
        b = min(a + BLOCK_BYTES, len(data))
        key = data[a:b].astype(np.int64)
        for j in range(1, depth + 1):
            key |= data[a - j : b - j].astype(np.int64) << (8 * j)
        key = key[real[a:b]]
        yield np.arange(done, done + len(key)), key
        done += len(key)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of equal weight, so that they compress well."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that the context of each gram goes to."""
    mixed = (keys >> 8).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


class _Chunk:
    """Texts of a chunk on their way to rows: blocks of text, and how often the training texts hold each gram and word."""

    def __init__(self, number: int, depth: int, parts: int, schema: pa.Schema):
        self.number, self.depth, self.parts, self.schema, self.bytes = number, depth, parts, schema, 0
        self.words: dict[bytes, int] = {}
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._open()

    def _open(self) -> None:
        self.ids, self.held, self.texts, self.block = [], [], [], 0

    def add(self, doc_id: pa.Scalar, text: bytes | None, held: bool) -> None:
        words = words_of(text)
        body = b" ".join(words) + END
        for w in (*words, END):
            self.words[w] = self.words.get(w, 0) + (not held)
        self.ids.append(doc_id)
        self.held.append(held)
        self.texts.append(body)
        self.block += len(body)
        self.bytes += len(body)

    def block_row(self) -> pa.RecordBatch:
        pad = END * self.depth
        sizes, held = np.array([len(x) for x in self.texts], np.int64), np.array(self.held)
        padded = b"".join(pad + x for x in self.texts)
        owner = np.repeat(held, sizes)
        for place, key in grams(padded, sizes, self.depth):
            out = owner[place]
            known, n = np.unique(key[~out], return_counts=True)
            other = np.unique(key[out])
            self.keys, self.counts = _merged(np.concatenate([self.keys, known, other]), np.concatenate([self.counts, n, np.zeros(len(other), np.int64)]))
        row = {"doc_ids": [x.as_py() for x in self.ids], "held": held.tolist(), "sizes": sizes.tolist(), "body": zstandard.ZstdCompressor(level=1).compress(padded)}
        self._open()
        return self._rows([row])

    def count_rows(self) -> pa.RecordBatch:
        rows = []
        part = _part(self.keys, self.parts)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(self.parts), side="right")
        for p in np.unique(part).tolist():
            here = order[ends[p - 1] if p else 0 : ends[p]]
            rows.append({"part": p, "grams": _packed(np.diff(self.keys[here], prepend=0)), "n": _packed(self.counts[here])})
        dealt = defaultdict(list)
        for w in sorted(self.words):
            dealt[zlib.crc32(w) % self.parts].append(w)
        for p, words in dealt.items():
            body = zstandard.ZstdCompressor(level=1).compress(b" ".join(words))
            rows.append({"part": p, "words": body, "n": _packed(np.array([self.words[w] for w in words], np.int64))})
        return self._rows(rows)

    def _rows(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"chunk": self.number, **r} for r in rows], schema=self.schema)


def gather(docs: DataFrame, held_out: Column, depth: int, parts: int) -> DataFrame:
    """One pass over the texts, cut into chunks: rows with a ``body`` (texts), and a row for each part of its ``grams`` and ``words``.

    A chunk names every gram and word once, with ``n``, its number in the chunk's training texts. Contexts and words are dealt
    to ``parts`` by hash, all grams of a context to the same.
    """
    picked = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    ddl = f"chunk long, doc_ids array<{kind}>, held array<boolean>, sizes array<long>, body binary, part long, grams binary, words binary, n binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, chunk = None, None
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if schema is None:
                lists = [pa.list_(batch.schema.field(0).type), pa.list_(pa.bool_()), pa.list_(pa.int64())]
                types = [pa.int64(), *lists, pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                schema = pa.schema(list(zip((x.split()[0] for x in ddl.split(", ")), types, strict=True)))
            for doc_id, text, held in zip(*batch.columns, strict=True):
                if chunk is None:
                    chunk = _Chunk(number, depth, parts, schema)
                    number += 1
                chunk.add(doc_id, text.as_py(), held.as_py())
                if chunk.block >= BLOCK_BYTES:
                    yield chunk.block_row()
                if chunk.bytes >= CHUNK_BYTES:
                    if chunk.texts:
                        yield chunk.block_row()
                    yield chunk.count_rows()
                    chunk = None
        if chunk is not None:
            if chunk.texts:
                yield chunk.block_row()
            yield chunk.count_rows()

    return picked.mapInArrow(run, ddl)


def _steps(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The eight decisions of the last byte of each gram: the node (context and bits so far) and the bit."""
    byte, context = keys & 255, keys & ~np.int64(255)
    for i in range(8):
        yield context | (1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1


def _nodes(table: pa.Table) -> pa.Table:
    """The deepest nodes of a part of the contexts, with the number of their 0 and 1 bits over all chunks."""
    keys, n = _merged(
        np.concatenate([np.cumsum(_unpacked(x.as_py())) for x in table.column("grams")]), np.concatenate([_unpacked(x.as_py()) for x in table.column("n")])
    )
    out = []
    for node, bit in _steps(keys):
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        out.append((node[first], np.add.reduceat(n * (1 - bit), first), np.add.reduceat(n * bit, first)))
    node, n0, n1 = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.Table.from_arrays([pa.array(np.full(len(node), table.column("part")[0].as_py())), pa.array(node), pa.array(n0), pa.array(n1)], names=["part", "node", "n0", "n1"])


def _gram_values(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each chunk, the values of its grams of a part."""
    node, stop = right.column("node").to_numpy(), right.column("stop").to_numpy()
    order = np.argsort(node)
    node, stop = node[order], stop[order]
    asked = [np.cumsum(_unpacked(x.as_py())) for x in left.column("grams")]
    keys = np.unique(np.concatenate(asked)) if asked else np.zeros(0, np.int64)
    value = np.zeros(len(keys), np.int64)
    for at, bit in _steps(keys):
        p = stop[np.searchsorted(node, at)]
        value += np.round(np.log10(np.where(bit == 1, p, 1 - p)) * UNIT).astype(np.int64)
    values = [_packed(value[np.searchsorted(keys, x)]) for x in asked]
    return pa.Table.from_arrays([left.column("chunk"), left.column("grams"), pa.array(values, pa.binary())], names=["of", "grams", "values"])


def _word_counts(table: pa.Table) -> pa.Table:
    """For each chunk, how often training holds its words of a part; and a row without a chunk, with the number of tokens and of different words."""
    lists = [zstandard.ZstdDecompressor().decompress(x.as_py()).split(b" ") for x in table.column("words")]
    total: dict[bytes, int] = {}
    for words, n in zip(lists, table.column("n"), strict=True):
        for w, c in zip(words, _unpacked(n.as_py()).tolist(), strict=True):
            total[w] = total.get(w, 0) + c
    values = [_packed(np.array([total[w] for w in words], np.int64)) for words in lists]
    of, body = [*table.column("chunk").to_pylist(), None], [*table.column("words").to_pylist(), None]
    tokens, distinct = [None] * len(lists) + [sum(total.values())], [None] * len(lists) + [sum(c > 0 for c in total.values())]
    types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    columns = (of, body, [*values, None], tokens, distinct)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["of", "words", "values", "tokens", "known"])


def _log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x of 0.5 or more: Stirling's series seven places on, led back."""
    y = x + 7
    rising = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(rising)


def _level(nodes: DataFrame, deepest: bool) -> DataFrame:
    """Weigh the nodes of a level: ``p`` (Krichevsky-Trofimov estimate of bit 1), ``own`` (weight of the node against its
    children), ``share`` (log of the weighted probability, in units). ``n0``, ``n1``, and ``below``, the sum of the children's shares, are given."""
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    estimate = F.when(F.col("n0") + F.col("n1") == 0, F.lit(0.0)).otherwise(_log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1) - math.log(math.pi))
    out = nodes.withColumn("p", (n1 + 0.5) / (n0 + n1 + 1)).withColumn("kt", estimate)
    if deepest:
        out = out.withColumn("own", F.lit(1.0)).withColumn("weighted", F.col("kt"))
    else:
        gap = F.col("below") / F.lit(float(TREE_UNIT)) - F.col("kt")
        out = out.withColumn("gap", gap).withColumn("own", 1 / (1 + F.exp(F.least("gap", F.lit(700.0)))))
        out = out.withColumn("weighted", F.col("kt") + F.greatest("gap", F.lit(0.0)) + F.log1p(F.exp(-F.abs("gap"))) - math.log(2))
    return out.select("part", "node", "n0", "n1", "p", "own", F.round(F.col("weighted") * TREE_UNIT).cast("long").alias("share"))


def weigh_tree(rows: DataFrame, depth: int) -> DataFrame:
    """``part``, ``node`` and ``stop``, the probability of a 1 bit, per row of ``rows`` (the deepest nodes: ``part``, ``node``, ``n0``, ``n1``).

    A byte is eight binary decisions, each with a tree of its own over the bytes before: a node stands for the last d bytes,
    d from 0 to ``depth``. Its weighted probability is the mean of its own Krichevsky-Trofimov probability and the
    product of its children's. Each level is an aggregation of the one below; then the weights are carried down again:
    the probability of a bit is the mixture of the estimates along its path. Training counts stay as they are
    while texts are scored. A context that training has not seen adds nothing; the longest seen one has the rest.
    """
    levels = [materialize(_level(rows, True), f"tree-{depth}")]
    for d in range(depth - 1, -1, -1):
        shorter = levels[-1].withColumn("node", F.col("node").bitwiseAND(F.lit((1 << (8 * (d + 1))) - 1)))
        rows = shorter.groupBy("node").agg(F.lit(0).cast("long").alias("part"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("share").alias("below"))
        levels.append(materialize(_level(rows, False), f"tree-{d}"))
    seen = F.col("n0") + F.col("n1") > 0
    state = levels.pop().select(
        "part", F.col("node").alias("above"), (F.col("own") * F.col("p")).alias("mixed"), (1 - F.col("own")).alias("left"), F.when(seen, F.col("p")).otherwise(0.5).alias("stop")
    )
    for d in range(1, depth + 1):
        # a level of contexts of one byte or none has 65,280 nodes at most
        upper = state.drop("part")
        upper = F.broadcast(upper) if d <= 2 else upper
        down = levels.pop().withColumn("above", F.col("node").bitwiseAND(F.lit((1 << (8 * d)) - 1))).join(upper, "above")
        state = down.select(
            "part", F.col("node").alias("above"),
            (F.col("mixed") + F.col("left") * F.col("own") * F.col("p")).alias("mixed"),
            (F.col("left") * (1 - F.col("own"))).alias("left"),
            F.when(seen, F.col("mixed") + F.col("left") * F.col("p")).otherwise(F.col("stop")).alias("stop"),
        )
        state = materialize(state, f"tree-mix-{d}")
    return state.select("part", F.col("above").alias("node"), "stop")


def score_texts(docs: DataFrame, held_out: Column, depth: int = DEPTH) -> DataFrame:
    """Scores of every row of ``docs`` (``doc_id``, ``text``) by models of the rows for which ``held_out`` is not true.

    Returns ``doc_id``, ``held_out``, ``n_tokens``, ``n_known`` (tokens that training holds), ``train_tokens``, ``base_score``
    (log10 probability of the tokens by their counts, 0.5 added), ``score`` (log10 probability of the text by the context
    tree), ``n_bytes`` and ``bits_per_byte`` (its code length).

    Tokens are the words of the whole text, A-Z in lower case, and one end. The tree reads the same as bytes: the words
    with one space between, and END; so white space counts only as a border of words, for both scores. Texts are gathered
    in chunks; the counts of every gram and word of the training texts are summed over all chunks, in parts whose number grows with
    the texts; each chunk then gets the values of its own grams and words back, so that no table is sent whole to any task.

    A null text is empty (one token, the end). A null ``held_out`` is false. Repeated rows are scored and counted each; a null
    ``doc_id`` is a value like others; other columns are ignored; an empty table gives an empty result. Without training
    texts every bit has probability one half. Sums are over integers, so reruns agree.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth must be 1 to 6 bytes")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    found = materialize(gather(docs, held_out, depth, parts), "lm-gathered")
    by_gram = found.filter("grams IS NOT NULL").select("chunk", "part", "grams", "n")
    nodes = by_gram.groupBy("part").applyInArrow(_nodes, "part long, node long, n0 long, n1 long")
    stops = weigh_tree(nodes, depth).withColumnRenamed("part", "dealt")
    values = by_gram.groupBy("part").cogroup(stops.groupBy("dealt")).applyInArrow(_gram_values, "of long, grams binary, values binary")
    by_word = found.filter("words IS NOT NULL").select("chunk", "part", "words", "n")
    counts = materialize(by_word.groupBy("part").applyInArrow(_word_counts, "of long, words binary, values binary, tokens long, known long"), "lm-words")
    total = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()
    tokens, distinct = int(total["n"]), int(total["v"])
    texts = found.filter("body IS NOT NULL").select("chunk", "doc_ids", "held", "sizes", "body")
    looked_up = counts.filter("of IS NOT NULL").select("of", "words", "values").unionByName(values, allowMissingColumns=True)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    bottom = tokens + 0.5 * (distinct + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, value, seen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}
        for gram, word, data in zip(*(right.column(c) for c in ("grams", "words", "values")), strict=True):
            if gram.is_valid:
                keys.append(np.cumsum(_unpacked(gram.as_py())))
                value.append(_unpacked(data.as_py()))
            else:
                seen.update(zip(zstandard.ZstdDecompressor().decompress(word.as_py()).split(b" "), _unpacked(data.as_py()).tolist(), strict=True))
        index, value = pd.Index(np.concatenate(keys)), np.concatenate(value)
        out = []
        for ids, held, sizes, body in zip(*(left.column(c) for c in ("doc_ids", "held", "sizes", "body")), strict=True):
            sizes = np.array(sizes.as_py(), np.int64)
            padded = zstandard.ZstdDecompressor().decompress(body.as_py())
            ends = np.cumsum(sizes)
            sums = np.zeros(len(sizes), np.int64)
            for place, key in grams(padded, sizes, depth):
                one, last = np.searchsorted(ends, (place[0], place[-1]), side="right") if len(place) else (0, -1)
                starts = np.maximum(ends[one : last + 1] - sizes[one : last + 1] - place[0], 0) if len(place) else []
                if len(starts):
                    sums[one : last + 1] += np.add.reduceat(value[index.get_indexer(key)], starts)
            for k, (doc_id, is_held, size, end) in enumerate(zip(ids.as_py(), held.as_py(), sizes.tolist(), ends.tolist(), strict=True)):
                start = end - size + depth * (k + 1)
                body_words = padded[start : start + size - 1]
                c = np.array([seen[w] for w in (*(body_words.split(b" ") if body_words else ()), END)], np.float64)
                score = sums[k] / UNIT
                out.append((doc_id, is_held, len(c), int((c > 0).sum()), tokens, float(np.log10((c + 0.5) / bottom).sum()), score, size, -score / math.log10(2) / size))
        types = (left.column("doc_ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
        names = [part.split()[0] for part in ddl.split(", ")]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return texts.groupBy("chunk").cogroup(looked_up.groupBy("of")).applyInArrow(run, ddl)
