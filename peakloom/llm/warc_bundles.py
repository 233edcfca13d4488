"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames; a footer (a skippable frame) holds the seek table
of the seekable format: compressed and decompressed size and a checksum of every frame. An index
maps each record identifier to its bundle, frame and offset inside the frame, so that one record
is read by decompressing one frame. Of records with equal payloads of at least ``min_bytes``, the
one with the smallest page_id is a response and the others revisit it.

Defined cases: null html is an empty payload, a null url an empty one; a null page_id is smaller
than none: it is a response only where its payload has no other page, and its identifier says
``null``; rows that repeat a page_id with the same payload are all responses if that id is the
smallest; empty tables write no bundle and give an empty result; texts of any length are written
whole, a record longer than a frame being a frame of its own; columns besides page_id, url and
html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.functions.shared import run_dir, written

#: Decompressed bytes at which a frame, and at which a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 27
#: Tasks that read bundles back, at most; each then reads several.
MOST_TASKS = 1 << 16
# Fixed values of the seekable format: magic numbers of the skippable frame and of the footer, flag for checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    name = identifier.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "null" else int(name)


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response, or a revisit of ``refers_to`` without its payload, whose size is kept in a header of its own."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {0 if revisit else len(payload)}",
    ]
    if revisit:
        head.insert(2, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.insert(4, f"WARC-Refers-To: {record_id(refers_to)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length of the record at the start of ``data``."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    start, n = end + 4, int(headers["Content-Length"])
    return headers, data[start : start + n], start + n + 4


class BundleWriter:
    """Appends records to a stream; ``close`` writes the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES) -> None:
        self.out, self.frame_bytes = out, frame_bytes
        self.open: list[bytes] = []
        self.size, self.total, self.table = 0, 0, bytearray()
        self.frames = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset inside the frame."""
        if self.open and self.size + len(data) > self.frame_bytes:
            self._flush()
        place = self.frames, self.size
        self.open.append(data)
        self.size += len(data)
        self.total += len(data)
        return place

    def _flush(self) -> None:
        plain = b"".join(self.open)
        packed = zstandard.ZstdCompressor(level=3).compress(plain)
        self.out.write(packed)
        for value in (len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF):
            self.table += value.to_bytes(4, "little")
        self.frames, self.open, self.size = self.frames + 1, [], 0

    def close(self) -> None:
        if self.open:
            self._flush()
        footer = self.frames.to_bytes(4, "little") + bytes([CHECKSUMS]) + SEEKABLE.to_bytes(4, "little")
        self.out.write(SKIPPABLE.to_bytes(4, "little") + (len(self.table) + len(footer)).to_bytes(4, "little") + bytes(self.table) + footer)


class BundleReader:
    """Random access to frames of a bundle, by its seek table."""

    def __init__(self, source) -> None:
        self.source, size = source, source.size()
        source.seek(size - 9)
        footer = source.read(9)
        if int.from_bytes(footer[5:], "little") != SEEKABLE:
            raise ValueError("no seek table")
        n, width = int.from_bytes(footer[:4], "little"), 12 if footer[4] & CHECKSUMS else 8
        source.seek(size - 9 - n * width)
        table = source.read(n * width)
        self.entries, at = [], 0
        for i in range(n):
            row = table[i * width : (i + 1) * width]
            packed, plain = int.from_bytes(row[:4], "little"), int.from_bytes(row[4:8], "little")
            self.entries.append((at, packed, plain, int.from_bytes(row[8:], "little") if width == 12 else None))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, plain, checksum = self.entries[i]
        self.source.seek(at)
        data = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)
        if checksum is not None and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} is damaged")
        return data

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for i in range(len(self.entries)):
            data, at = self.frame(i), 0
            while at < len(data):
                headers, block, n = parse_record(data[at:] if at else data)
                yield headers, block
                at += n


def referenced(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to of all pages."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("d", F.sha1("html"))
    first = rows.where(F.octet_length("html") >= min_bytes).groupBy("d").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # only digests that repeat are joined; as a table of its own, so that Spark can split the rows of a hot digest
    first = written(first.where("n > 1 and first is not null").select(F.col("d").alias("digest"), "first"), "first-pages")
    wide = rows.join(first, F.col("d") == F.col("digest"), "left")
    return wide.select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("first") != F.col("page_id")), F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write all pages below ``folder``; the index page_id, bundle, frame, offset. The index is a table: bundles of lost or repeated tasks are not in it."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        writer, name, places = None, "", []

        def close() -> pa.RecordBatch:
            writer.close()
            writer.out.close()
            system.move(f"{path}/.{name}", f"{path}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in places], pa.int64()), pa.array([name] * len(places), pa.string()), pa.array([p[1] for p in places], pa.int64()), pa.array([p[2] for p in places], pa.int64())], ["page_id", "bundle", "frame", "offset"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*[batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to")], strict=True):
                if writer is None:
                    name, places = f"{uuid.uuid4().hex}.warc.zst", []
                    writer = BundleWriter(system.open_output_stream(f"{path}/.{name}", compression=None))
                places.append((page_id, *writer.add(record(page_id, url or "", html.encode(), refers_to))))
                if writer.total >= BUNDLE_BYTES:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    return written(referenced(pages, min_bytes).mapInArrow(write, "page_id long, bundle string, frame long, offset long"), "warc-index")


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the index's bundles: page_id, payload_bytes, payload_digest, record_type, refers_to. Payloads of responses are checked against their headers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["bundle"].to_pylist():
                rows = []
                with system.open_input_file(f"{path}/{name}") as source:
                    for headers, block in BundleReader(source).records():
                        revisit = headers["WARC-Type"] == "revisit"
                        size, sha = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and (len(block), digest(block)) != (size, sha):
                            raise ValueError(f"{headers['WARC-Record-ID']} is damaged")
                        rows.append((page_of(headers["WARC-Record-ID"]), size, sha, headers["WARC-Type"], page_of(headers["WARC-Refers-To"]) if revisit else None))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # a bundle is a task: with their number given, small groups of names are not put together
    names = written(index.select("bundle").distinct(), "bundles")
    tasks = min(max(1, names.count()), MOST_TASKS)
    placed = names.repartitionByRange(tasks, "bundle")
    return placed.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def look_up(index: DataFrame, folder: str, page_ids: DataFrame) -> DataFrame:
    """page_id, record_type and payload (null for revisits) of the pages in ``page_ids``, each read out of its frame alone."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for page_id, name, frame, offset in zip(*[batch[c].to_pylist() for c in ("page_id", "bundle", "frame", "offset")], strict=True):
                with system.open_input_file(f"{path}/{name}") as source:
                    headers, block, _ = parse_record(BundleReader(source).frame(frame)[offset:])
                revisit = headers["WARC-Type"] == "revisit"
                yield pa.RecordBatch.from_arrays([pa.array([page_id], pa.int64()), pa.array([headers["WARC-Type"]]), pa.array([None if revisit else block], pa.binary())], ["page_id", "record_type", "payload"])

    return index.join(page_ids.select("page_id").distinct(), "page_id").mapInArrow(fetch, "page_id long, record_type string, payload binary")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    folder = run_dir(pages.sparkSession, "warc")
    return read_bundles(write_bundles(pages, folder, min_bytes), folder)
