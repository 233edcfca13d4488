"""Media columns of MPEG audio.

``encode`` stores payloads as the ancillary data of silent MPEG-1 layer III frames, with an ID3v2
tag, a Xing header with seek table, CRC-protected frames and an ID3v1 tag. ``parse`` reads any
MPEG audio stream of stated bitrates (free format is skipped): it reads the text fields of ID3v2.3
and 2.4 tags and notes other tags, finds frame headers again after damage (a header counts if the
one after it agrees, or the stream ends there), reads the variable-bitrate table (Xing, Info or
VBRI), verifies the checksums of all three layers, and stores exact durations (in samples) and the
seek offset of every frame.

Defined cases: null payload text is empty and gives one frame of padding; texts of any length are
stored whole; streams without any frame parse to zero frames, a null rate and an empty payload; of
streams that ``encode`` did not write the payload is the frames' main data, up to UNIT bytes a frame;
equal payloads give equal bytes; repeated rows are each returned; columns besides doc_id and text
are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from peakloom.llm.arrow_words import slices

#: Bytes of payload in a frame; payloads are padded with bytes 255 to a positive multiple.
UNIT = 576
# Fixed values of MPEG audio: versions and layers by header bits, kbit/s by (group, index), Hz by version, Xing flags.
VERSIONS = {0: 2.5, 2: 2, 3: 1}
LAYERS = {1: 3, 2: 2, 3: 1}
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
XING_FRAMES, XING_BYTES, XING_TOC = 1, 2, 4
#: What ``encode`` writes: MPEG-1, layer III, CRC, 192 kbit/s, 44.1 kHz, mono: 626 bytes a frame, 17 of side information.
HEADER, FRAME, SIDE, RATE, SAMPLES = bytes([0xFF, 0xFA, 0xB0, 0xC0]), 626, 17, 44100, 1152


def _shifted(crc: int, bits: int) -> int:
    for _ in range(bits):
        crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


_CRC = [_shifted(byte << 8, 8) for byte in range(256)]


def crc16(data: bytes, bits: int | None = None) -> int:
    """CRC-16 of MPEG audio over the first ``bits`` (all): polynomial 0x8005, start 0xFFFF, no reflection."""
    crc, bits = 0xFFFF, 8 * len(data) if bits is None else bits
    for byte in data[: bits >> 3]:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ byte]
    if bits & 7:
        crc = _shifted(crc ^ (data[bits >> 3] >> (8 - (bits & 7)) << (16 - (bits & 7))), bits & 7)
    return crc


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbps: int
    rate: int
    size: int
    samples: int
    side: int
    channels: int
    bound: int

    @property
    def kind(self) -> tuple:
        return self.version, self.layer, self.rate


def _header(word: bytes, known: dict[bytes, Header | None]) -> Header | None:
    """Header of 4 bytes, or None. Free format is not supported."""
    if word in known:
        return known[word]
    known[word] = found = None
    if len(word) == 4 and word[0] == 0xFF and word[1] >> 5 == 7:
        version, layer = VERSIONS.get(word[1] >> 3 & 3), LAYERS.get(word[1] >> 1 & 3)
        index, rate_index, pad = word[2] >> 4, word[2] >> 2 & 3, word[2] >> 1 & 1
        if version and layer and 0 < index < 15 and rate_index < 3 and word[3] & 3 != 2:
            kbps, rate = BITRATES[1 if version == 1 else 2, layer][index], RATES[version][rate_index]
            samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
            size = (12 * kbps * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + pad
            mode, extension = word[3] >> 6, word[3] >> 4 & 3
            mono = mode == 3
            side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
            found = Header(version, layer, not word[1] & 1, kbps, rate, size, samples, side, 1 if mono else 2, 4 * (extension + 1) if mode == 1 else 32)
    known[word] = found
    return found


@dataclass
class Stream:
    """What ``parse`` found. Offsets are those of frames, from the stream's first byte; the frame of a bitrate table is not among them."""

    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    fields: dict[str, str] = field(default_factory=dict)
    table: dict | None = None
    skipped: int = 0
    bad_checksums: int = 0
    checked: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)


def _synchsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def parse(data: bytes) -> Stream:
    out, known, sums = Stream(), {}, {}
    at, end = 0, len(data)
    if data[-128:-125] == b"TAG" and end >= 128:
        out.tags.append("ID3v1")
        end -= 128
    while data[at : at + 3] == b"ID3" and end - at >= 10:
        out.tags.insert(0, f"ID3v2.{data[at + 3]}")
        out.fields |= _text_fields(data[at : at + 10 + _synchsafe(data[at + 6 : at + 10])])
        at += 10 + _synchsafe(data[at + 6 : at + 10]) + (10 if data[at + 5] & 16 else 0)
    synced = False
    while at + 4 <= end:
        h = _header(data[at : at + 4], known)
        if h and at + h.size <= end and not synced:
            after = _header(data[at + h.size : at + h.size + 4], known)
            synced = at + h.size == end or (after is not None and after.kind == h.kind)
            h = h if synced else None
        elif not h or at + h.size > end:
            synced, h = False, None
        if h is None:
            out.skipped += 1
            following = data.find(b"\xff", at + 1, end)
            out.skipped += (following if following >= 0 else end) - at - 1
            at = following if following >= 0 else end
            continue
        body = at + 4 + 2 * h.protected
        if h.protected:
            bits = _guarded_bits(h, data, body)
            guarded = data[at + 2 : at + 4] + data[body : body + -(-bits // 8)], bits
            if guarded not in sums:
                sums[guarded] = crc16(guarded[0], 16 + bits)
            out.checked += 1
            out.bad_checksums += sums[guarded] != int.from_bytes(data[at + 4 : at + 6])
        mark = data[body + h.side : body + h.side + 4]
        if not out.headers and out.table is None and mark in (b"Xing", b"Info"):
            out.table = _xing(data, body + h.side, at)
        elif not out.headers and out.table is None and data[at + 36 : at + 40] == b"VBRI":
            out.table = _vbri(data, at + 36, at)
        else:
            out.offsets.append(at)
            out.headers.append(h)
        at += h.size
    out.skipped += max(0, end - at)
    return out


def _xing(data: bytes, at: int, frame: int) -> dict:
    flags, place = int.from_bytes(data[at + 4 : at + 8]), at + 8
    table: dict = {"mark": data[at : at + 4].decode(), "frame": frame}
    for bit, name in ((XING_FRAMES, "frames"), (XING_BYTES, "bytes")):
        if flags & bit:
            table[name] = int.from_bytes(data[place : place + 4])
            place += 4
    if flags & XING_TOC:
        table["toc"] = list(data[place : place + 100])
    return table


def _vbri(data: bytes, at: int, frame: int) -> dict:
    """Bytes and frames of the stream, and the bytes of each of its equal stretches."""
    number = lambda i, n: int.from_bytes(data[at + i : at + i + n])
    entries, scale, width = number(18, 2), number(20, 2), number(22, 2)
    toc = [number(26 + width * i, width) * scale for i in range(entries)]
    return {"mark": "VBRI", "frame": frame, "bytes": number(10, 4), "frames": number(14, 4), "frames_an_entry": number(24, 2), "toc": toc}


def _text_fields(tag: bytes) -> dict[str, str]:
    """Text frames of an ID3v2.3 or 2.4 tag by their names."""
    out, at = {}, 10
    if tag[3] not in (3, 4) or tag[5] & 0xC0:  # other versions, unsynchronised or extended tags
        return out
    codecs = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
    while at + 10 < len(tag) and tag[at] == ord("T"):
        size = _synchsafe(tag[at + 4 : at + 8]) if tag[3] == 4 else int.from_bytes(tag[at + 4 : at + 8])
        body = tag[at + 10 : at + 10 + size]
        if body and body[0] in codecs:
            out[tag[at : at + 4].decode("latin-1")] = body[1:].decode(codecs[body[0]], "replace").rstrip("\0")
        at += 10 + size
    return out


# Fixed values of layer II: bits of a subband's allocation, for the subbands from 0, by table.
ALLOCATION_BITS = {"a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "low": [4] * 4 + [3] * 7 + [2] * 19}


def _allocation_bits(h: Header) -> list[int]:
    a_channel = h.kbps // h.channels
    if h.version != 1:
        return ALLOCATION_BITS["low"]
    if a_channel >= 56 and (h.rate == 48000 or a_channel <= 80):
        return ALLOCATION_BITS["a"]
    if a_channel >= 96:
        return ALLOCATION_BITS["b"]
    return ALLOCATION_BITS["d" if h.rate == 32000 else "c"]


def _guarded_bits(h: Header, data: bytes, at: int) -> int:
    """Bits from ``at`` on that a frame's checksum covers: side information in layer III, allocations in I, also of scale-factor choices in II."""
    if h.layer == 3:
        return 8 * h.side
    shared = lambda band: h.channels == 2 and band >= h.bound
    if h.layer == 1:
        return sum(4 * (1 if shared(band) else h.channels) for band in range(32))
    bits, place, chosen = _allocation_bits(h), 0, 0
    value = int.from_bytes(data[at : at + 64].ljust(64, b"\0"))
    for band, width in enumerate(bits):
        for _ in range(1 if shared(band) else h.channels):
            if value >> (512 - place - width) & ((1 << width) - 1):
                chosen += h.channels if shared(band) else 1
            place += width
    return place + 2 * chosen


def seek(stream: Stream, sample: int) -> int:
    """Offset of the frame that holds ``sample``; the last frame's for later ones."""
    ends = np.cumsum([h.samples for h in stream.headers])
    return stream.offsets[min(int(np.searchsorted(ends, sample, "right")), len(ends) - 1)]


_SIDE = bytes(SIDE)
_HEAD = HEADER + crc16(HEADER[2:] + _SIDE).to_bytes(2) + _SIDE


def encode(payload: bytes) -> bytes:
    """An MPEG stream that carries ``payload``, whose length is a positive multiple of UNIT."""
    n = len(payload) // UNIT
    frames = np.zeros((n, FRAME), np.uint8)
    frames[:, : len(_HEAD)] = np.frombuffer(_HEAD, np.uint8)
    frames[:, len(_HEAD) : len(_HEAD) + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    total = FRAME * (n + 1)
    toc = bytes((FRAME + FRAME * (n * i // 100)) * 256 // total for i in range(100))
    xing = _HEAD + b"Xing" + (XING_FRAMES | XING_BYTES | XING_TOC).to_bytes(4) + n.to_bytes(4) + total.to_bytes(4) + toc
    title = b"\x00payload"
    frame = b"TIT2" + len(title).to_bytes(4) + b"\x00\x00" + title
    tag = b"ID3\x03\x00\x00" + bytes([0, 0, len(frame) >> 7, len(frame) & 127]) + frame
    return tag + xing.ljust(FRAME, b"\x00") + frames.tobytes() + b"TAG".ljust(128, b"\x00")


def decode(data: bytes, stream: Stream) -> bytes:
    """What frames hold behind header, checksum and side information, UNIT bytes each at most: the payload that ``encode`` stored; of other streams the frames' main data, cut at each frame's end."""
    starts = [o + 4 + 2 * h.protected + h.side for o, h in zip(stream.offsets, stream.headers, strict=True)]
    ends = [min(s + UNIT, o + h.size) for s, o, h in zip(starts, stream.offsets, stream.headers, strict=True)]
    if starts and all(e - s == UNIT for s, e in zip(starts, ends, strict=True)):
        return np.frombuffer(data, np.uint8)[np.array(starts)[:, None] + np.arange(UNIT)].tobytes()
    return b"".join(data[s:e] for s, e in zip(starts, ends, strict=True))


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\xff")


def feature(data: bytes, stream: Stream) -> str:
    """Exact duration, kinds and rates, table and checksum findings, and a digest of the seek offsets."""
    kinds = sorted({f"mpeg{h.version:g}-layer{h.layer}-{h.rate}" for h in stream.headers})
    rates = sorted({h.kbps for h in stream.headers})
    offsets = zlib.crc32(np.array(stream.offsets, "<u8").tobytes())
    table = stream.table or {}
    rate = stream.headers[0].rate if stream.headers else 0
    return f"samples={stream.samples};rate={rate};frames={len(stream.offsets)};kinds={','.join(kinds)};kbps={','.join(map(str, rates))};tags={','.join(stream.tags)};table={table.get('mark', '-')}:{table.get('frames', '-')};skipped={stream.skipped};bad_checksums={stream.bad_checksums}/{stream.checked};offsets={offsets:08x}"


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the whole text as an MPEG stream."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [(t or "").encode() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(map(len, raw), pa.int64()), pa.array([encode(padded(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(write, "doc_id long, n_bytes long, media binary")


def with_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, what the stored bytes decode to, exact duration in samples, sample rate, and frame seek offsets."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, data in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"].to_pylist(), strict=True):
                data = data or b""
                stream = parse(data)
                payload = decode(data, stream)
                rows.append({
                    "doc_id": doc_id, "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
                    "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature(data, stream),
                    "samples": stream.samples, "rate": stream.headers[0].rate if stream.headers else None, "bad_checksums": stream.bad_checksums, "offsets": stream.offsets,
                })
            yield pa.RecordBatch.from_pylist(rows, schema=_FEATURES)

    return media.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, rate long, bad_checksums long, offsets array<long>")


_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("samples", pa.int64()), ("rate", pa.int64()), ("bad_checksums", pa.int64()), ("offsets", pa.list_(pa.int64()))])
