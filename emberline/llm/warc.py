"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import materialize, scratch_path

#: Fixed values of the two formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An archive of more bytes is closed after the record at hand.
ARCHIVE_BYTES = 64 << 20
#: Read and written at a time.
CHUNK = 1 << 20
LEVEL = 3
#: The dictionary is trained on so many payloads of so many bytes at most, all on the driver.
SAMPLES = 400
SAMPLE_BYTES = 64 << 10
DICTIONARY_BYTES = 64 << 10
#: Archives are read by so many tasks at most, by one each if there are no more.
READ_TASKS = 50_000
#: Pages with fewer payload bytes are never revisits.
MIN_REVISIT_BYTES = 0

MANIFEST = "archive string, records long, bytes long"
RECORD = (
    "archive string, offset long, record_type string, record_id string, page_id long, target_uri string, "
    "payload_digest string, refers_to_id string, payload binary"
)


class BadArchive(ValueError):
    """An archive that breaks the format; names the file and the offset of the frame."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"


def build_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit that names the response with the page id ``first``."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{record_id(page_id, digest)}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", f"<{record_id(first, digest)}>" if revisit else None),
        ("X-Page-Id", None if page_id is None else str(page_id)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


@dataclass
class Record:
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


def parse_record(data: bytes) -> Record:
    """The record that fills ``data``; raises ``BadArchive`` for a malformed header or a wrong length."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not version.startswith("WARC/1."):
        raise BadArchive("no WARC header")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise BadArchive(f"malformed field {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BadArchive(f"no {name}")
    if not fields["content-length"].isdecimal():
        raise BadArchive("Content-Length is no number")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadArchive(f"Content-Length is {length}, the frame holds {len(rest) - 4}")
    record = Record(fields, rest[:length])
    digest = fields.get("warc-payload-digest", "")
    if fields["warc-type"] == "response" and digest.startswith("sha1:") and digest[5:] != payload_digest(record.payload):
        raise BadArchive("the payload does not have its digest")
    return record


class Frames:
    """Iterates over (offset, decoded frame) of an open archive, with one frame in memory at a time."""

    def __init__(self, stream):
        self.stream, self.buffer, self.at = stream, b"", 0
        self.decoder = zstandard.ZstdDecompressor()
        self._dictionary()

    def _fill(self, size: int) -> bool:
        while len(self.buffer) < size and (more := self.stream.read(CHUNK)):
            self.buffer += more
        return len(self.buffer) >= size

    def _take(self, size: int) -> bytes:
        if not self._fill(size):
            raise BadArchive("the archive ends within a frame")
        out, self.buffer = self.buffer[:size], self.buffer[size:]
        self.at += size
        return out

    def _dictionary(self) -> None:
        """Load the dictionary from the leading skippable frame, which may itself be compressed; none is fine too."""
        if not self._fill(8) or struct.unpack_from("<I", self.buffer)[0] != DICTIONARY_MAGIC:
            return
        _, size = struct.unpack("<II", self._take(8))
        data = self._take(size)
        if len(data) >= 4 and struct.unpack_from("<I", data)[0] == FRAME_MAGIC:
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        if data:
            self.decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while self._fill(1):
            start = self.at
            if not self._fill(4) or struct.unpack_from("<I", self.buffer)[0] != FRAME_MAGIC:
                raise BadArchive("no Zstandard frame")
            frame, parts = self.decoder.decompressobj(), []
            while not frame.eof:
                if not self._fill(1):
                    raise BadArchive("the archive ends within a frame")
                chunk, self.buffer = self.buffer, b""
                parts.append(frame.decompress(chunk))
                self.buffer = frame.unused_data
                self.at += len(chunk) - len(self.buffer)
            yield start, b"".join(parts)


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the records of at most SAMPLES pages (``page_id``, ``url``, ``payload``) of at most SAMPLE_BYTES each.

    They are chosen by hash, and only they come to the driver. Empty if they do not suffice for a dictionary.
    """
    small = pages.filter(F.octet_length("payload").between(64, SAMPLE_BYTES)).withColumn("_at", F.xxhash64("payload"))
    chosen = small.select("_at").distinct().orderBy("_at").limit(SAMPLES)
    sample = small.join(F.broadcast(chosen), "_at", "left_semi").groupBy("_at").agg(F.min(F.struct("page_id", "url", "payload")).alias("p")).orderBy("_at").select("p.*").collect()
    samples = [build_record(r["page_id"], r["url"], bytes(r["payload"]), None, False) for r in sample]
    total = sum(map(len, samples))
    if len(samples) < 16 or total < 16 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_warc(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (``page_id`` integer, ``url``, ``html``) and return the manifest of archives.

    Rows with equal payloads of at least ``min_revisit_bytes`` bytes share a response, the row with the smallest
    ``page_id``; the others become revisits of it. A null html is an empty payload; a null ``page_id`` counts as larger than
    any other, so that its row is a response only if no equal payload has an id; repeated rows with the smallest id are all
    responses; a null url leaves the target out; an empty table gives no archive; other columns are ignored. Each
    task streams its records into files of the shared folder; the manifest names the files of attempts that succeeded, and
    files of lost attempts are never read. Only digests are grouped, so a payload on a third of all pages is no large group.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    dictionary = train_dictionary(rows)
    keyed = rows.withColumn("key", F.sha1("payload"))
    # stored, so that the join is free of the aggregation and Spark can split the partition of a payload that many pages share
    firsts = materialize(keyed.groupBy("key").agg(F.min("page_id").alias("first")), "warc-firsts")
    shared = F.octet_length("payload") >= min_revisit_bytes
    decided = keyed.join(firsts, "key").select("page_id", "url", "payload", "first", (shared & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))
    folder = scratch_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
        written, out, records, size = [], None, 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{len(written):04d}.warc.zst"
                    store.create_dir(root, recursive=True)
                    out, records = store.open_output_stream(f"{root}/{name}", compression=None), 0
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                    size = 8 + len(dictionary)
                frame = coder.compress(build_record(*row))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    written.append((f"{folder}/{name}", records, size))
                    out = None
        if out is not None:
            out.close()
            written.append((f"{folder}/{name}", records, size))
        if written:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*written, strict=True)], names=["archive", "records", "bytes"])

    return materialize(decided.mapInArrow(run, MANIFEST), "warc-manifest")


def read_warc(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """The records of the archives named in the column ``archive``: see RECORD; one row per record.

    A task streams whole archives and holds one record at a time. The payload is the HTTP body (of a revisit: empty),
    ``page_id`` the field ``X-Page-Id`` if there is one. A damaged frame, header, length or digest raises ``BadArchive``
    with the file and the offset. A null or repeated name is skipped or read once; no names give no rows.
    The names are counted and dealt to as many tasks; adaptive execution, which would merge so few bytes into one task, leaves
    an explicit number of partitions alone.
    """
    names = archives.filter("archive IS NOT NULL").select("archive").distinct()
    names = names.repartitionByRange(max(1, min(names.count(), READ_TASKS)), "archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(archive)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    at = 0
                    try:
                        for at, data in Frames(stream):  # noqa: B007
                            record = parse_record(data)
                            f = record.fields
                            page = f.get("x-page-id", "")
                            digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
                            rows.append((archive, at, f["warc-type"], f["warc-record-id"].strip("<>"), int(page) if page.lstrip("-").isdecimal() else None, f.get("warc-target-uri"), digest or None, f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None, record.payload))
                            held += len(record.payload) + 500
                            if held > 8 * CHUNK:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                                rows, held = [], 0
                    except (BadArchive, zstandard.ZstdError) as e:
                        raise BadArchive(f"{archive}, frame after offset {at}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return names.mapInArrow(run, RECORD)


def page_records(records: DataFrame) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` of records that ``read_warc`` gives.

    A revisit gets the length of the payload and the page id of the response it names; both null if that is missing.
    """
    light = materialize(records.select("page_id", "record_type", "record_id", "payload_digest", "refers_to_id", F.octet_length("payload").cast("long").alias("payload_bytes")), "warc-records")
    responses = light.filter("record_type = 'response'")
    named = responses.groupBy(F.col("record_id").alias("_id")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("_bytes"))
    revisits = light.filter("record_type = 'revisit'").join(named, F.col("refers_to_id") == F.col("_id"), "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", F.col("_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    )
