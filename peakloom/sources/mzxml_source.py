"""mzXML as a data source of Spark: ``spark.read.format("mzxml")`` and ``df.write.format("mzxml")``.

A document is its head, its scans and its tail. A scan's row holds the text from its start tag to the
next one's: attributes, what stands before, in and behind its peaks, and ``closing``, the text from its
first end tag on. So rows in document order are the document, nesting included, whatever its depth, and
a row needs nothing of another: partitions are ranges of bytes, each of the scans that begin in it.

Filters on num, rt, scan_type and peaks_count are pushed down: scans that fail are passed over unparsed.
Where num is asked for by value, a document's own index (offsets of scans, found from its end) is used,
and only the wanted ranges are opened; an index that is missing or does not lead to the scans that it
names is not trusted, and the document is scanned.

Files are opened with ``pyarrow.fs`` by the tasks. Files named ``part-*`` in a folder are one document,
joined in the order of their names, and read like one file. ``<scan`` in comments or CDATA sections is taken for a scan; text is read
as the XML declaration says (UTF-8 without one), in encodings that extend ASCII.
"""

from __future__ import annotations

import base64
import bisect
import contextlib
import dataclasses
import itertools
import re
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

from peakloom.functions.scalars import seconds_of

SCHEMA = (
    "document string, at long, num int, scan_type string, rt double, rt_text string, peaks_count int, attributes map<string,string>, "
    "before string, peaks struct<_VALUE:string,_precision:int,_compressionType:string,_compressedLen:int>, peaks_attributes map<string,string>, after string, closing string"
)
_PEAKS = pa.struct([("_VALUE", pa.string()), ("_precision", pa.int32()), ("_compressionType", pa.string()), ("_compressedLen", pa.int32())])
_ARROW = pa.schema([
    ("document", pa.string()), ("at", pa.int64()), ("num", pa.int32()), ("scan_type", pa.string()), ("rt", pa.float64()), ("rt_text", pa.string()), ("peaks_count", pa.int32()),
    ("attributes", pa.map_(pa.string(), pa.string())), ("before", pa.string()), ("peaks", _PEAKS), ("peaks_attributes", pa.map_(pa.string(), pa.string())), ("after", pa.string()), ("closing", pa.string()),
])
#: Bytes of a partition and of a read; rows and bytes of a batch that goes to Spark.
SPLIT_BYTES, CHUNK_BYTES, BATCH_ROWS, BATCH_BYTES = 64 << 20, 1 << 20, 4096, 4 << 20
#: Bytes from the end in which the place of the index must be said.
TAIL_BYTES = 4096
#: Bytes of a read where single scans are looked up.
LOOK_BYTES = 1 << 14
_START = re.compile(rb"<scan(?=[\s/>])")
_END = re.compile(rb"</scan\s*>")
_TAG = re.compile(r"""<[^\s<>/]+(?:\s+[^\s=<>]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*/?>""")
_ATTRIBUTE = re.compile(r"""([^\s=<>"']+)\s*=\s*("[^"]*"|'[^']*')""")
_PEAKS_ELEMENT = re.compile(r"(<peaks(?=[\s/>])[^>]*?)(?:/>|>(.*?)</peaks\s*>)", re.DOTALL)
_INDEX_AT = re.compile(rb"<indexOffset[^>]*>\s*(\d+)\s*</indexOffset\s*>")
_INDEX_ENTRY = re.compile(rb"""<offset\s[^>]*?\bid\s*=\s*["'](\d+)["'][^>]*>\s*(\d+)\s*<""")
_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def unescaped(text: str) -> str:
    """Text of an attribute, its entities and character numbers resolved."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name.startswith("#"):
            return chr(int(name[2:], 16) if name[1] in "xX" else int(name[1:]))
        return _ENTITIES.get(name, m[0])

    return re.sub(r"&(#?\w+);", one, text)


def attributes_of(tag: str) -> dict[str, str]:
    return {k: unescaped(v[1:-1]) for k, v in _ATTRIBUTE.findall(tag)}


def _number(kind: Callable, text: str | None) -> Any:
    try:
        return None if text is None else kind(text)
    except ValueError:
        return None


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def documents_of(uri: str) -> list[tuple[str, int]]:
    """(path, size) of the documents at ``uri``: a file, or the files and folders of parts in a folder."""
    system, path = opened(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and not any(x.startswith((".", "_")) for x in f.path[len(path) :].strip("/").split("/"))]
    sizes: dict[str, int] = {}
    for f in found:
        document = f.path.rsplit("/", 1)[0] if f.base_name.startswith("part-") and not info.is_file else f.path
        sizes[document] = sizes.get(document, 0) + f.size
    return sorted(sizes.items())


class Joined:
    """A file, or the parts of a folder as one. ``bytes_read`` counts."""

    def __init__(self, system: fs.FileSystem, path: str) -> None:
        info = system.get_file_info(path)
        parts = [info] if info.is_file else sorted((f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name.startswith("part-")), key=lambda f: f.path)
        self.system, self.paths, self.bytes_read, self.at = system, [f.path for f in parts], 0, 0
        self.ends = list(itertools.accumulate(f.size for f in parts))
        self.size, self.open = self.ends[-1] if parts else 0, (-1, None)

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        out = b""
        while n > len(out) and self.at < self.size:
            k = bisect.bisect_right(self.ends, self.at)
            if self.open[0] != k:
                self.close()
                self.open = (k, self.system.open_input_file(self.paths[k]))
            self.open[1].seek(self.at - (self.ends[k - 1] if k else 0))
            more = self.open[1].read(min(n - len(out), self.ends[k] - self.at))
            out, self.at, self.bytes_read = out + more, self.at + len(more), self.bytes_read + len(more)
        return out

    def close(self) -> None:
        if self.open[1] is not None:
            self.open[1].close()
        self.open = (-1, None)


def encoding_of(head: bytes) -> str:
    said = re.search(rb"""<\?xml[^>]*\bencoding\s*=\s*["']([\w.-]+)["']""", head[:400])
    return said[1].decode() if said else "utf-8"


@dataclasses.dataclass
class Segment:
    """The bytes from a scan's start tag to the next one's."""

    at: int
    data: bytes

    def start_tag(self, encoding: str) -> str:
        m = _TAG.match(self.data[: 1 << 16].decode(encoding, "replace"))
        if m is None:
            raise ValueError(f"the start tag of the scan at byte {self.at} is broken")
        return m[0]


def segments(f: Joined, start: int, end: int, chunk: int = CHUNK_BYTES) -> Iterator[Segment]:
    """The scans that begin in bytes [start, end) of ``f``; the last one's data may hold the tail of its document."""
    f.seek(start)
    data, base, search, last = b"", start, 0, None
    while True:
        for m in _START.finditer(data, search):
            at = base + m.start()
            if last is not None:
                yield Segment(last, data[last - base : m.start()])
            last = at if at < end else None
            if last is None:
                return
        kept = data[last - base :] if last is not None else data[-5:]  # a tag may be cut
        base += len(data) - len(kept)
        if last is None and base >= end:
            return
        more = f.read(chunk)
        if not more:
            break
        data, search = kept + more, max(len(kept) - 5, 0 if last is None else 1)
    if last is not None:
        yield Segment(last, kept)


def split_segment(data: str, tag: str) -> tuple[str, str]:
    """What a scan holds itself, and its closing: from its first end tag on, without the tail of the document."""
    rest = data[len(tag) :]
    if tag.endswith("/>"):
        own, closing = "", "</scan>" + rest
    else:
        m = re.search(r"</scan\s*>", rest)
        own, closing = (rest[: m.start()], rest[m.start() :]) if m else (rest, "")
    return own, closing


def without_tail(closing: str) -> str:
    """The closing of a file's last scan ends with its last end tag."""
    ends = list(re.finditer(r"</scan\s*>", closing))
    return closing[: ends[-1].end()] if ends else ""


Test = tuple[str, str, Any]


def passes(tests: list[Test], row: dict[str, Any]) -> bool:
    for op, column, value in tests:
        own = row[column]
        if own is None:
            return False
        ok = {"=": lambda: own == value, "in": lambda: own in value, ">": lambda: own > value, ">=": lambda: own >= value, "<": lambda: own < value, "<=": lambda: own <= value, "there": lambda: True}[op]()  # noqa: B023
        if not ok:
            return False
    return True


def said_of(tag: str) -> dict[str, Any]:
    """What filters look at, and all attributes."""
    a = attributes_of(tag)
    rt = a.get("retentionTime")
    return {"num": _number(int, a.get("num")), "scan_type": a.get("scanType"), "rt": seconds_of(rt), "rt_text": rt, "peaks_count": _number(int, a.get("peaksCount")), "attributes": a}


def row_of(segment: Segment, said: dict[str, Any], tag: str, encoding: str, whole: bool) -> dict[str, Any]:
    """The columns of a scan but for its document. whole: the segment may hold the tail."""
    own, closing = split_segment(segment.data.decode(encoding), tag)
    m = _PEAKS_ELEMENT.search(own)
    peaks, peaks_attributes, before, after = None, None, own, ""
    if m:
        peaks_attributes = attributes_of(m[1])
        before, after = own[: m.start()], own[m.end() :]
        peaks = {"_VALUE": m[2], "_precision": _number(int, peaks_attributes.get("precision")), "_compressionType": peaks_attributes.get("compressionType"), "_compressedLen": _number(int, peaks_attributes.get("compressedLen"))}
    return said | {"at": segment.at, "attributes": list(said["attributes"].items()), "before": before, "peaks": peaks, "peaks_attributes": None if peaks_attributes is None else list(peaks_attributes.items()), "after": after, "closing": without_tail(closing) if whole else closing}


def rows_between(f: Joined, start: int, end: int, tests: list[Test]) -> Iterator[dict[str, Any]]:
    """Rows of the scans that begin in [start, end) and pass ``tests``."""
    f.seek(0)
    encoding = encoding_of(f.read(400))
    for s in segments(f, start, end):
        tag = s.start_tag(encoding)
        said = said_of(tag)
        if passes(tests, said):
            yield row_of(s, said, tag, encoding, s.at + len(s.data) >= f.size)


def index_place(f: Joined) -> int | None:
    """Where the document says that its index is, if something of the kind is there."""
    f.seek(max(0, f.size - TAIL_BYTES))
    said = _INDEX_AT.search(f.read(TAIL_BYTES))
    if said is None or int(said[1]) >= f.size:
        return None
    f.seek(int(said[1]))
    return int(said[1]) if re.match(rb"""\s*<index\s[^>]*\bname\s*=\s*["']scan["']""", f.read(200)) else None


def index_of(f: Joined) -> dict[int, int] | None:
    """Byte offsets of the scans by num, as the document's own index says; None where it has none."""
    at = index_place(f)
    if at is None:
        return None
    f.seek(at)
    data = f.read(f.size - at)
    return {int(k): int(v) for k, v in _INDEX_ENTRY.findall(data[: data.find(b"</index")])}


def looked_up(f: Joined, nums: list[int], tests: list[Test]) -> list[dict[str, Any]] | None:
    """Rows of the scans ``nums``, each read from its offset; None where the index is missing, lacks a num although it has not all scans of the head's count, or leads elsewhere."""
    index = index_of(f)
    if index is None:
        return None
    f.seek(0)
    head = f.read(LOOK_BYTES)
    encoding, out = encoding_of(head), []
    if any(n not in index for n in nums):
        said = re.search(rb"""<msRun\s[^>]*\bscanCount\s*=\s*["'](\d+)["']""", head)
        if said is None or int(said[1]) != len(index):
            return None
    for at in sorted(index[n] for n in nums if n in index):
        segment = next(segments(f, at, at + 1, LOOK_BYTES), None)
        if segment is None:
            return None
        tag = segment.start_tag(encoding)
        said = said_of(tag)
        if index.get(said["num"]) != at:
            return None
        if passes(tests, said):
            out.append(row_of(segment, said, tag, encoding, at + len(segment.data) >= f.size))
    return out


def batches(document: str, rows: Iterator[dict[str, Any]], texts: bool) -> Iterator[pa.RecordBatch]:
    """Rows for Spark; without ``texts`` what stands before, in and behind peaks is null."""
    held: list[dict[str, Any]] = []
    size = 0
    for r in rows:
        r["document"] = document
        if not texts:
            r |= {"before": None, "peaks": None, "peaks_attributes": None, "after": None}
        held.append(r)
        size += len((r["peaks"] or {}).get("_VALUE") or "") + len(r["before"] or "") + len(r["after"] or "")
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, _ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _ARROW)


@dataclasses.dataclass
class Part(D.InputPartition):
    document: str
    start: int
    end: int
    nums: list[int] | None = None


_OPS = {D.EqualTo: "=", D.In: "in", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<=", D.IsNotNull: "there"}


class Reader(D.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("mzxml needs a path")
        self.uri, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.indexed, self.texts = (options.get(k, "true").lower() == "true" for k in ("index", "texts"))
        self.tests: list[Test] = []

    def pushFilters(self, filters: list[D.Filter]):  # noqa: N802
        for f in filters:
            if type(f) in _OPS and len(f.attribute) == 1 and f.attribute[0] in ("num", "scan_type", "rt", "peaks_count"):
                self.tests.append((_OPS[type(f)], f.attribute[0], None if isinstance(f, D.IsNotNull) else f.value))
            else:
                yield f

    def partitions(self) -> list[Part]:
        wanted = [{v} if op == "=" else set(v) for op, column, v in self.tests if column == "num" and op in ("=", "in")]
        nums = sorted(set.intersection(*wanted) - {None}) if wanted and self.indexed else None
        out = []
        for document, size in documents_of(self.uri):
            # two small reads, so that a document without an index is scanned in many tasks
            if nums is not None and self._with(document, index_place) is not None:
                out.append(Part(document, 0, size, nums))
            else:
                out += [Part(document, at, min(size, at + self.split)) for at in range(0, size, self.split)]
        return out

    def _with(self, document: str, work: Callable[[Joined], Any]) -> Any:
        with contextlib.closing(Joined(opened(self.uri)[0], document)) as f:
            return work(f)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        with contextlib.closing(Joined(opened(self.uri)[0], part.document)) as f:
            rows = None if part.nums is None else looked_up(f, part.nums, self.tests)
            yield from batches(part.document, rows_between(f, part.start, part.end, self.tests) if rows is None else iter(rows), self.texts)


@dataclasses.dataclass
class Wrote(D.WriterCommitMessage):
    partition: int
    name: str
    scans: int
    least: tuple[float, str] | None
    greatest: tuple[float, str] | None


class Writer(D.DataSourceArrowWriter):
    """One document as a folder of parts, from rows (value, scans, rt, rt_text) in document order, partition after partition.

    Tasks write below a folder of the job; the commit moves the parts of the tasks that succeeded,
    ahead of them the head with the counts that they report, behind them the tail. So a lost
    task's file never becomes part of the document, and nothing is visible before the commit.
    """

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.uri, self.overwrite = options["path"], overwrite
        self.head, self.tail = (base64.b64decode(options[k]).decode() for k in ("head", "tail"))
        self.encoding, self.job = encoding_of(self.head.encode()), f"_writing-{uuid.uuid4().hex}"

    def _system(self) -> tuple[fs.FileSystem, str]:
        return opened(self.uri)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        system, path = self._system()
        partition, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        system.create_dir(f"{path}/{self.job}", recursive=True)
        scans, times = 0, []
        with system.open_output_stream(f"{path}/{self.job}/{name}") as out:
            for batch in iterator:
                for value in batch["value"].to_pylist():
                    out.write(value.encode(self.encoding, "xmlcharrefreplace"))
                scans += sum(batch["scans"].to_pylist())
                own = [(rt, text) for n, rt, text in zip(batch["scans"].to_pylist(), batch["rt"].to_pylist(), batch["rt_text"].to_pylist(), strict=True) if n and rt is not None]
                times = [min(own + times, key=lambda t: t[0]), max(own + times, key=lambda t: t[0])] if own or times else []
        return Wrote(partition, name, scans, times[0] if times else None, times[-1] if times else None)

    def commit(self, messages: list[Wrote | None]) -> None:
        system, path = self._system()
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        old = [f.path for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.is_file and f.base_name.startswith("part-")]
        if old and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.uri} holds a document; a document cannot be appended to")
        for f in old:
            system.delete_file(f)
        times = [t for m in done for t in (m.least, m.greatest) if t]
        told = {"scanCount": str(sum(m.scans for m in done))} | ({"startTime": min(times, key=lambda t: t[0])[1], "endTime": max(times, key=lambda t: t[0])[1]} if times else {})
        system.create_dir(path, recursive=True)
        for k, text in ((0, with_run(self.head, told)), (len(done) + 1, self.tail)):
            with system.open_output_stream(f"{path}/part-{k:06d}.mzXML") as out:
                out.write(text.encode(self.encoding, "xmlcharrefreplace"))
        for k, m in enumerate(done, 1):
            system.move(f"{path}/{self.job}/{m.name}", f"{path}/part-{k:06d}.mzXML")
        self.abort(messages)

    def abort(self, messages: list[Wrote | None]) -> None:
        system, path = self._system()
        if system.get_file_info(f"{path}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{path}/{self.job}")


def escaped(text: str) -> str:
    for plain, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;"), ("\r", "&#13;")):
        text = text.replace(plain, by)
    return text


def with_run(head: str, told: dict[str, str]) -> str:
    """``head`` with attributes of its msRun set: in place where it has them, else behind the others."""
    m = re.search(r"""<msRun(?:\s+[^\s=<>]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*(?=/?>)""", head)
    if m is None:
        return head
    tag = m[0].rstrip()
    for k, v in told.items():
        own = f'{k}="{escaped(v)}"'
        tag, n = re.subn(rf"""(?<=\s){k}\s*=\s*(?:"[^"]*"|'[^']*')""", lambda _, own=own: own, tag)
        tag = tag if n else f"{tag} {own}"
    return head[: m.start()] + tag + head[m.end() :]


class MzxmlSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "mzxml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def head_and_tail(uri: str) -> tuple[str, str]:
    """The text of a document ahead of its first scan, and the text behind its last, ``index`` left out."""
    documents = documents_of(uri)
    if len(documents) != 1:
        raise ValueError(f"{uri} is not one document")
    with contextlib.closing(Joined(opened(uri)[0], documents[0][0])) as f:
        data = b""
        while (more := f.read(CHUNK_BYTES)) and not _START.search(data + more, max(0, len(data) - 6)):
            data += more
        data += more
        encoding, first = encoding_of(data), _START.search(data)
        if first is None:
            cut = data.find(b"</msRun")
            return data[: cut if cut >= 0 else None].decode(encoding), without_index(data[cut:] if cut >= 0 else b"").decode(encoding)
        at, end = f.size, b""
        while at > 0 and not re.search(rb"</scan\s*>|<scan[\s/>]", end):
            at = max(0, at - CHUNK_BYTES)
            f.seek(at)
            end = f.read(f.size - len(end) - at) + end
        last = max((m.end() for m in re.finditer(rb"""</scan\s*>|<scan(?:\s[^<>]*)?/>""", end)), default=len(end))
        return data[: first.start()].decode(encoding), without_index(end[last:]).decode(encoding)


def without_index(tail: bytes) -> bytes:
    return re.sub(rb"<index(?=[\s>]).*?</index\s*>", b"", tail, flags=re.DOTALL)


def register(spark: SparkSession) -> None:
    """Make ``mzxml`` known to the session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MzxmlSource)
