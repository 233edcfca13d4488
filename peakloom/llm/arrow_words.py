"""Words of whole texts in Arrow batches, for operators that run in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once (a longer text is worked on alone); bounds memory, not results.
SLICE_BYTES = 8 << 20
#: Tables for bytes.translate: A-Z to a-z, and white space to 1, the rest to 0.
_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
_SPACE = bytes(b == 32 or 9 <= b < 14 for b in range(256))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``texts`` end to end, and the n + 1 offsets. Nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """``batches`` cut so that the texts (or bytes) of each part have SLICE_BYTES, and ``most``, at most or are one row."""
    size = min(SLICE_BYTES, most or SLICE_BYTES)
    for batch in batches:
        ends, i = np.concatenate([[0], np.cumsum(pc.binary_length(batch[text]).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)]), 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (a published finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of bytes: two multilinear hashes with multipliers by place, mixed into one."""
    size = np.diff(offsets)
    if not len(size):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(offsets[:-1], size)
    steps = np.arange(1, int(size.max()) + 1, dtype=np.uint64)
    keys = [mixed(steps * np.uint64(step)) for step in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    value = data.astype(np.uint64) + np.uint64(1)
    full = size > 0
    one, two = np.zeros((2, len(size)), np.uint64)
    for out, key in zip((one, two), keys, strict=True):
        out[full] = np.add.reduceat(value * key[place], offsets[:-1][full]) if full.any() else np.uint64(0)
    return mixed(one ^ mixed(two + size.astype(np.uint64)))


def hash_of(word: bytes) -> int:
    return int(hashed(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0])


def coded_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray | None = None) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """The distinct words of texts (``data`` between ``offsets``); the words of all texts, end to end, as places among them; each text's number of words."""
    space = np.frombuffer(data.tobytes().translate(_SPACE), bool) if space is None else space
    starts = ~space
    starts[1:] &= space[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    starts[firsts] = ~space[firsts]
    counts = np.diff(np.searchsorted(np.flatnonzero(starts), offsets))
    kept = data[~space]
    bounds = np.append(np.flatnonzero(starts[~space]), len(kept)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), counts


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct words with A-Z in lower case; the words of all texts, end to end, as places among them; each text's number of words."""
    data, offsets = utf8(texts)
    lowered = data.tobytes().translate(_LOWER)
    words, places, counts = coded_words(np.frombuffer(lowered, np.uint8), offsets, np.frombuffer(lowered.translate(_SPACE), bool))
    _, ends, distinct = words.buffers()
    ends = np.frombuffer(ends, np.int64)[: len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return hashed(np.frombuffer(distinct, np.uint8)[: ends[-1]] if len(ends) > 1 else np.zeros(0, np.uint8), ends), places, counts
