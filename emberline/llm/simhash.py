"""SimHash near-dedup: fingerprints, and bit-sliced comparison of those that share a block of bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.llm.components import components
from emberline.session import broadcast_if_small, materialize

#: Words per shingle.
SHINGLE = 3
SEED = 42
#: Fingerprints link at this many differing bits or fewer. The carry-save counters below hold two bits.
RADIUS = 3
#: The 64 bits are cut into blocks; differing bits touch RADIUS of them at most, so two fingerprints that link
#: agree on all bits of some BLOCKS - RADIUS blocks.
BLOCKS = (13, 13, 13, 13, 12)
#: Shingles hashed at a time.
CHUNK = 65_536
#: Planes after which words are abandoned whose fingerprints are all beyond the radius.
ABANDON = 8
#: A bucket of more fingerprints is cut into tiles, one for each two of its parts.
TILE = 4096
#: Ids of documents lie below; fingerprints that only rows without an id have get numbers from here.
NO_ID = 1 << 62


def fingerprint(text: bytes) -> int:
    """Bit b is set if it is set in over half of the shingle hashes; 0 without words. ASCII case is folded."""
    words = text.lower().split()  # bytes: only A-Z, and exactly the six white-space bytes
    if not words:
        return 0
    shingles = iter([b" ".join(words)]) if len(words) < SHINGLE else map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    counts, total = np.zeros(64, np.int64), 0
    while len(hashes := np.fromiter(map(xxhash.xxh64_intdigest, islice(shingles, CHUNK), repeat(SEED)), "<u8")):
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``bits`` (the fingerprint as a signed long) per row; a null text is empty."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(t.as_py() or b"") for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, bits long")


def bit_planes(bits: np.ndarray) -> np.ndarray:
    """64 rows, one for each bit of the fingerprints, packed 64 fingerprints to a word; two words of zeros follow."""
    raw = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.zeros((64, 8 * (-(-len(bits) // 64) + 2)), np.uint8)
    packed = np.packbits(raw.T, axis=1, bitorder="little")
    planes[:, : packed.shape[1]] = packed
    return planes.view("<u8")


def within_radius(planes: np.ndarray, step: int, asked: np.ndarray) -> np.ndarray:
    """Which of the ``asked`` fingerprints (ascending numbers) differ in RADIUS bits or fewer from the one ``step`` places on.

    Every word of a plane holds a bit of 64 fingerprints, and one operation compares it with the plane moved by ``step``
    places. Two bits of carry-save counters and a sticky overflow tell distances 0 to 3 from all others. Words are the
    blocks: one in which all that is asked for has overflowed is abandoned, which is looked at every ABANDON planes.
    """
    words, place = np.unique(asked >> 6, return_inverse=True)
    active = np.zeros(len(words), np.uint64)
    np.bitwise_or.at(active, place, np.uint64(1) << (asked & 63).astype(np.uint64))
    ahead, move = step >> 6, np.uint64(step & 63)
    ones, twos, over = (np.zeros(len(words), np.uint64) for _ in range(3))
    for k in range(64):
        plane = planes[k]
        other = plane[words + ahead]
        if move:
            other = (other >> move) | (plane[words + ahead + 1] << (np.uint64(64) - move))
        differ = plane[words] ^ other
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry
        if k % ABANDON == ABANDON - 1:
            go = (active & ~over) != 0
            if not go.all():
                words, active, ones, twos, over = (x[go] for x in (words, active, ones, twos, over))
                if not len(words):
                    break
    near = np.unpackbits((active & ~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(near)
    return words[word] * 64 + bit


def _links(keys: np.ndarray, bits: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smaller id) that connect all ids whose fingerprints link and share a key; rows come sorted by key."""
    n = len(keys)
    root, planes = np.arange(n), bit_planes(bits)

    def unite(i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            ri, rj = root[i], root[j]
            np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
            while (root[root] != root).any():
                root[:] = root[root]
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]

    step = 1
    open_rows = np.arange(n - 1)
    while len(open_rows := open_rows[open_rows + step < n]):
        open_rows = open_rows[keys[open_rows] == keys[open_rows + step]]  # keys are sorted: once apart, apart for good
        if len(open_rows):
            near = within_radius(planes, step, open_rows)
            unite(near, near + step)
        step += 1
    linked = np.flatnonzero(root != np.arange(n))
    return ids[linked], ids[root[linked]]


def _bucket_rows(distinct: DataFrame) -> DataFrame:
    """A row for each fingerprint and each choice of blocks that must agree, keyed by the bits of these blocks."""
    starts = [sum(BLOCKS[:k]) for k in range(len(BLOCKS))]
    part = [F.shiftrightunsigned("bits", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, BLOCKS, strict=True)]
    keys = []
    for number, chosen in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS)):
        key = F.lit(number).cast("long")
        for k in chosen:
            key = F.shiftleft(key, BLOCKS[k]).bitwiseOR(part[k])
        keys.append(key)
    rows = distinct.select("id", "bits", F.explode(F.array(*keys)).alias("key"))
    # a large bucket is cut into parts by hash; each two parts meet in one tile
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE)
    large = materialize(large.select("key", F.ceil(F.col("n") / TILE).cast("int").alias("parts")), "simhash-large")
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("bits"), parts).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), parts - 1), lambda other: F.least(own, other) * parts + F.greatest(own, other))
    return rows.join(broadcast_if_small(large, 64), "key", "left").select("id", "bits", "key", F.explode(tiles).alias("tile"))


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """``node``, ``component`` for the ``id`` of every fingerprint (``id``, ``bits``; each distinct) with a link."""

    def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The sorted rows, cut so that no group is parted; what waits is never more than a group, which a tile bounds."""
        waiting = []
        for batch in batches:
            key, tile = batch.column("key").to_numpy(), batch.column("tile").to_numpy()
            if not len(key):
                continue
            last = waiting[-1] if waiting else batch
            first = np.append((key[0] != last.column("key")[-1].as_py()) | (tile[0] != last.column("tile")[-1].as_py()), (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]))
            starts = np.flatnonzero(first)
            if not len(starts):
                waiting.append(batch)
                continue
            if waiting or starts[-1]:
                yield pa.Table.from_batches([*waiting, batch.slice(0, starts[-1])])
            waiting = [batch.slice(starts[-1])]
        if waiting:
            yield pa.Table.from_batches(waiting)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            key, tile, bits, ids = (table.column(c).to_numpy() for c in ("key", "tile", "bits", "id"))
            change = np.append(0, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]))
            u, v = _links(np.cumsum(change), bits.view(np.uint64), ids)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    rows = _bucket_rows(distinct).repartition("key", "tile").select("id", "bits", "key", "tile").sortWithinPartitions("key", "tile", "id")
    return components(rows.mapInArrow(run, "u long, v long"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` per row of ``docs`` (``doc_id`` integer, ``text``).

    Fingerprints of 3-word shingles link at 3 or fewer differing bits; ``component_id`` is the smallest ``doc_id`` that
    links reach, the document's own included. Documents with equal fingerprints become one row before anything is
    compared, so a group of copies of any size costs one comparison per distinct fingerprint. A null or empty text has
    fingerprint zero and links like any other. A null ``doc_id`` never names a component: its row gets the smallest id
    that its fingerprint reaches, or null if there is none. Repeated rows give repeated results; other columns are
    ignored; an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs), "simhash")
    distinct = prints.groupBy("bits").agg(F.min(F.col("doc_id").cast("long")).alias("id"))
    # fingerprints that only rows without an id have still carry links; of two that share a number all but two bits agree
    shared = materialize(distinct.select("bits", "id", F.coalesce("id", F.lit(NO_ID) + F.shiftrightunsigned("bits", 2)).alias("node")), "simhash-distinct")
    found = link_fingerprints(shared.select(F.col("node").alias("id"), "bits"))
    groups = shared.join(found, "node", "left").select("bits", F.coalesce("component", "node").alias("component"))
    component = F.when(F.col("component") < NO_ID, F.col("component"))
    return prints.join(groups, "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), component.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each SimHash group does: the one with the smallest ``doc_id``.

    Of rows with one ``doc_id`` one stays, the first by text. Documents without an id cannot be told apart and stay.
    """
    named = docs.filter("doc_id IS NOT NULL")
    kept = simhash_groups(named).filter("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    first = Window.partitionBy("doc_id").orderBy("text")
    staying = named.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi").withColumn("_copy", F.row_number().over(first)).filter("_copy = 1")
    return staying.drop("_copy").unionByName(docs.filter("doc_id IS NULL"))
