"""Elias-Fano coded monotone sequences in numpy, with vectorised access and search, and files of arrays that are memory-mapped."""

from __future__ import annotations

import functools
import json
import uuid

import numpy as np
from pyarrow import fs

_U = np.uint64
_BYTES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
_PAIRS, _FOURS, _EIGHTS = _U(0x5555555555555555), _U(0x3333333333333333), _U(0x0F0F0F0F0F0F0F0F)


def _select_in_bytes() -> np.ndarray:
    """Place of the k-th one of byte b, at b * 8 + k."""
    out = np.zeros((256, 8), np.uint8)
    for b in range(256):
        places = [i for i in range(8) if b >> i & 1]
        out[b, : len(places)] = places
    return out.ravel()


_IN_BYTE = _select_in_bytes()


def _select_in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one of each word: the byte by running counts of ones, then a table."""
    k = k.astype(np.uint64)
    s = x - ((x >> _U(1)) & _PAIRS)
    s = (s & _FOURS) + ((s >> _U(2)) & _FOURS)
    s = ((s + (s >> _U(4))) & _EIGHTS) * _BYTES
    place = np.bitwise_count((((k * _BYTES) | _TOPS) - s) & _TOPS).astype(np.uint64) << _U(3)
    k -= ((s << _U(8)) >> place) & _U(255)
    return (place + _IN_BYTE[(((x >> place) & _U(255)) << _U(3) | k).astype(np.int64)]).astype(np.int64)


class EliasFano:
    """``n`` non-decreasing numbers: low bits packed, high bits in unary, with counts of ones and zeros ahead of every word."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.width, self.low, self.high, self.ones, self.zeros = n, width, low, high, ones, zeros

    @staticmethod
    def build(values: np.ndarray) -> tuple[dict, dict[str, np.ndarray]]:
        """Numbers and arrays to be stored."""
        values, n = values.astype(np.uint64), len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        place = np.arange(n, dtype=np.int64)
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width and n:
            part, bit = values & _U((1 << width) - 1), place * width
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = shift + _U(width) > 64
            low[word[over] + 1] |= part[over] >> (_U(64) - shift[over])
        bit = (values >> _U(width)).astype(np.int64) + place
        high = np.zeros((n + (top >> width)) // 64 + 2, np.uint64)
        if n:
            word = bit >> 6
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            high[word[first]] = np.bitwise_or.reduceat(_U(1) << (bit & 63).astype(np.uint64), first)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
        small = np.uint32 if len(high) < 1 << 26 else np.uint64
        return {"n": n, "width": width}, {"low": low, "high": high, "ones": ones.astype(small), "zeros": zeros.astype(small)}

    def _select(self, ahead: np.ndarray, i: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(ahead, i.astype(ahead.dtype), "right") - 1
        x = self.high[word]
        return word * 64 + _select_in_word(~x if flip else x, i - ahead[word].astype(np.int64))

    def _following(self, ahead: np.ndarray, place: np.ndarray, i: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the one (or zero) next to the i-th, which is at ``place``."""
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        x = self.high[word]
        rest = ((~x if flip else x) >> bit) >> _U(1)
        after = place + 1 + np.bitwise_count((rest & (~rest + _U(1))) - _U(1)).astype(np.int64)
        far = np.flatnonzero(rest == 0)
        after[far] = self._select(ahead, i[far] + 1, flip)
        return after

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        spill = np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return ((self.low[word] >> shift) | spill) & _U((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        return (((self._select(self.ones, i, False) - i).astype(np.uint64)) << _U(self.width)) | self._low(i)

    def access_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th and the next number."""
        i = i.astype(np.int64)
        place = self._select(self.ones, i, False)
        after = self._following(self.ones, place, i, False)
        value = lambda p, k: (((p - k).astype(np.uint64)) << _U(self.width)) | self._low(k)
        return value(place, i), value(after, i + 1)

    def find(self, targets: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """Place of each target in its range [begin, end), or -1."""
        if not self.n or not len(targets):
            return np.full(len(targets), -1, np.int64)
        targets = targets.astype(np.uint64)
        h = (targets >> _U(self.width)).astype(np.int64)
        want = targets & _U((1 << self.width) - 1)
        last = int(self.zeros[-1]) - 1
        out_of = (h < 0) | (h > last)
        h = np.where(out_of, 0, h)
        # the ones of numbers with these high bits lie between the zeros h - 1 and h, which mostly share a word
        before = np.maximum(h - 1, 0)
        place = self._select(self.zeros, before, True)
        after = self._following(self.zeros, place, before, True)
        lo = np.maximum(np.where(h > 0, place - before, 0), begin)
        hi = np.minimum(np.where(h > 0, after - h, place), self.n if end is None else end)
        stop = hi.copy()
        todo = np.flatnonzero((lo < hi) & ~out_of)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._low(mid) < want[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        ok = np.flatnonzero((lo < stop) & ~out_of)
        found = np.full(len(targets), -1, np.int64)
        hit = ok[self._low(lo[ok]) == want[ok]]
        found[hit] = lo[hit]
        return found

    def decode(self) -> np.ndarray:
        bits = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))[: self.n]
        i = np.arange(self.n, dtype=np.int64)
        return ((bits - i).astype(np.uint64) << _U(self.width)) | self._low(i)


def save(folder: str, name: str, numbers: dict, arrays: dict[str, np.ndarray]) -> int:
    """Write one file below the URI ``folder``; it appears whole or not at all. Returns its bytes."""
    index, at = {}, 0
    for k, a in arrays.items():
        index[k] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    head = json.dumps({"numbers": numbers, "arrays": index}).encode()
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(len(head).to_bytes(8, "little"))
        out.write(head.ljust(-(-(len(head) + 8) // 64) * 64 - 8))
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(bytes(-a.nbytes % 64))
    system.move(part, f"{path}/{name}")
    return at


@functools.lru_cache(maxsize=4096)
def _mapped(path: str) -> np.ndarray:
    return np.asarray(np.memmap(path, np.uint8, "r"))


@functools.lru_cache(maxsize=32)
def _fetched(folder: str, name: str) -> np.ndarray:
    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{path}/{name}") as source:
        return np.frombuffer(source.read(), np.uint8)


def load(folder: str, name: str) -> tuple[dict, dict[str, np.ndarray]]:
    """Numbers and arrays of a file. On a file system it is memory-mapped; from other stores it is read, and the last few are kept."""
    system, path = fs.FileSystem.from_uri(folder)
    return parsed(_mapped(f"{path}/{name}") if isinstance(system, fs.LocalFileSystem) else _fetched(folder, name))


def parsed(data: np.ndarray) -> tuple[dict, dict[str, np.ndarray]]:
    size = int.from_bytes(data[:8].tobytes(), "little")
    head, start = json.loads(data[8 : 8 + size].tobytes()), -(-(size + 8) // 64) * 64
    return head["numbers"], {k: data[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in head["arrays"].items()}


def prefixed(name: str, built: tuple[dict, dict[str, np.ndarray]]) -> tuple[dict, dict[str, np.ndarray]]:
    return {f"{name}.{k}": v for k, v in built[0].items()}, {f"{name}.{k}": v for k, v in built[1].items()}


def stored(name: str, numbers: dict, arrays: dict[str, np.ndarray]) -> EliasFano:
    return EliasFano(numbers[f"{name}.n"], numbers[f"{name}.width"], *[arrays[f"{name}.{k}"] for k in ("low", "high", "ones", "zeros")])
