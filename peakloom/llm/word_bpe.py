"""Encoding and decoding with the public word BPE, merged by segment trees over adjacent pair ranks.

A word's leaf i holds the rank of the pair that begins at symbol i, with its place, and every inner
node the least of its two children. So the root is the leftmost pair of lowest rank; a merge changes
three leaves, each a logarithmic walk to the root, until the root says that no pair is left. Words of
up to SHORT_WORD symbols have their trees side by side in one matrix a size, where every step is one
of all words that are not done; longer words have a tree of their own. So long words cost n log n.

Texts are cut at white space, which neither the normaliser nor the pattern of words reaches across.
The distinct stretches of a slice are normalised and split together (printable ASCII by a pattern of
equal meaning, the others by the tokenizer's own normaliser and splitter), their distinct words are
merged once, and ids are dealt to all places. Nothing is kept between slices.

Defined cases: null and blank texts have no ids; strings of the vocabulary's added tokens are those
tokens, wherever they stand in a text; decoding joins token strings with spaces as the vocabulary
has no decoder; null ids decode to empty text, unknown ids are an error; rows that repeat, null keys
and empty tables need no care, since each row is its own; columns that are named like a result get
underscores.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType
from tokenizers import Tokenizer

from peakloom.llm.arrow_words import coded_words, slices, utf8
from peakloom.llm.columns import column, own_columns

#: Words of more symbols have a tree of their own (the work differs, not the ids); from LONG_WORD on it is kept in machine numbers.
SHORT_WORD, LONG_WORD = 64, 1 << 15
#: Leaves of the trees that are side by side at once; bounds memory.
CELLS = 1 << 20
#: Stretches that go through the tokenizer's normaliser and splitter together.
TOGETHER = 4096
_NONE = 1 << 62
_PLACE = (1 << 36) - 1
#: The vocabulary's pattern of words, for lower-case printable ASCII; a line's end ends a stretch.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\n]+|\n")


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def merged(symbols: Sequence[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """``symbols`` after all merges. ranks: (rank, merged symbol) of a pair."""
    n = len(symbols)
    if n < 2:
        return list(symbols)
    own = list if n < LONG_WORD else functools.partial(array, "q")
    symbols, after, before, m = own(symbols), own(range(1, n + 1)), own(range(-1, n - 1)), n - 1
    none = (0, 0)

    def key(i: int, j: int) -> int:
        found = ranks.get((symbols[i], symbols[j]), none)
        return found[0] << 36 | i if found is not none else _NONE

    tree = own([_NONE]) * (2 * m)
    for i in range(m):
        tree[m + i] = key(i, i + 1)
    for k in range(m - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = m + i
        tree[k] = value
        while k > 1:
            k >>= 1
            value = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == value:
                break
            tree[k] = value

    while tree[1] != _NONE:
        i = tree[1] & _PLACE
        j = after[i]
        symbols[i] = ranks[symbols[i], symbols[j]][1]
        after[i] = k = after[j]
        symbols[j] = -1
        if j < m:
            put(j, _NONE)
        if k < n:
            before[k] = i
            put(i, key(i, k))
        else:
            put(i, _NONE)
        if before[i] >= 0:
            put(before[i], key(before[i], i))
    return [s for s in symbols if s >= 0]


class Pairs:
    """Ranks of pairs of symbols, for arrays of them; symbols below 0 pair with nothing."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]) -> None:
        code = np.array([a << 20 | b for a, b in ranks], np.int64)
        order = np.argsort(code)
        self.code, self.rank = code[order], np.array([r for r, _ in ranks.values()], np.int64)[order]
        self.none = len(ranks)
        self.made = np.zeros(len(ranks), np.int64)
        self.made[self.rank] = np.array([m for _, m in ranks.values()], np.int64)[order]

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``none`` where it has none."""
        code = left << 20 | right
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where((self.code[at] == code) & (left >= 0) & (right >= 0), self.rank[at], self.none)


def merged_together(symbols: np.ndarray, ends: np.ndarray, pairs: Pairs) -> np.ndarray:
    """``symbols`` after all merges, -1 where a merge took one away, for words of up to SHORT_WORD symbols that end at ``ends``."""
    out, sizes = symbols.copy(), np.diff(ends, prepend=0)
    classes = np.where(sizes > 1, np.ceil(np.log2(np.maximum(sizes, 2))).astype(int), 0)
    for c in np.unique(classes[classes > 0]).tolist():
        own = np.flatnonzero(classes == c)
        for k in range(0, len(own), CELLS >> c):
            of = own[k : k + (CELLS >> c)]
            _side_by_side(out, ends[of] - sizes[of], sizes[of], c, pairs)
    return out


def _side_by_side(symbols: np.ndarray, first: np.ndarray, n: np.ndarray, depth: int, pairs: Pairs) -> None:
    """Merge words of ``n`` symbols that begin at ``first``, each in a column; row 0 and the row behind a word's last are marks that pair with nothing, and leaf i is the pair that begins in row i."""
    m, w, place = 1 << depth, len(n), np.arange(1 << depth)[:, None]
    inside = place < n
    held = np.full((m + 2, w), -1, np.int64)
    held[1 : m + 1][inside] = symbols[(first + place)[inside]]
    after, before = (np.repeat(np.arange(k, k + m + 2)[:, None], w, 1).ravel() for k in (1, -1))
    most = pairs.none * m
    tree = np.full((2 * m, w), most, np.int64)
    rank = pairs.of(held[1:m].ravel(), held[2 : m + 1].ravel()).reshape(m - 1, w)
    tree[m + 1 :] = np.minimum(rank * m + place[1:], most)
    for k in range(m - 1, 0, -1):
        np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])
    tree, rows = tree.ravel(), held.ravel()

    def put(leaf: np.ndarray, value: np.ndarray | int, word: np.ndarray) -> None:
        node = leaf + m
        tree[node * w + word] = value
        for _ in range(depth):
            node >>= 1
            tree[node * w + word] = np.minimum(tree[2 * node * w + word], tree[(2 * node + 1) * w + word])

    word = np.arange(w)
    while len(word := word[tree[w + word] < most]):
        root = tree[w + word]
        i, took = root % m, pairs.made[root // m]
        j = after[i * w + word]
        k, h = after[j * w + word], before[i * w + word]
        rows[i * w + word], rows[j * w + word] = took, -1
        after[i * w + word], before[k * w + word] = k, i
        pair = j < m
        put(j[pair], most, word[pair])
        put(i, np.minimum(pairs.of(took, rows[k * w + word]) * m + i, most), word)
        put(h, np.minimum(pairs.of(rows[h * w + word], took) * m + h, most), word)
    symbols[(first + place)[inside]] = held[1 : m + 1][inside]


class Codec:
    """The word BPE at ``path``, without truncation, padding and tokens that it adds by itself."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        own = Tokenizer.from_file(path)
        self.normalizer, self.splitter = own.normalizer, own.pre_tokenizer
        end, vocab = told["model"]["end_of_word_suffix"], told["model"]["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in told["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.pairs = Pairs(self.ranks)
        letters = {ord(t): i for t, i in vocab.items() if len(t) == 1}
        self.inner, self.last = np.full((2, max(letters) + 1), -1, np.int64)
        for c, i in letters.items():
            self.inner[c], self.last[c] = i, vocab[chr(c) + end]
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.marks = re.compile("|".join(f"({re.escape(t)})" for t in self.added))
        strings = {i: t for t, i in {**vocab, **self.added}.items()}
        self.tokens = pa.array([(strings[i] + " ").encode() if i in strings else None for i in range(max(strings) + 2)], pa.large_binary())

    def _split(self, text: str) -> list[str]:
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def _alone(self, text: str) -> list[str]:
        """Words of a stretch; an added token is one of its own string, which the splitter never makes."""
        parts = self.marks.split(text)
        return [w for part in parts if part for w in ([part] if part in self.added else self._split(part))]

    def _split_together(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Words of stretches without added tokens, end to end, and each one's number of words."""
        normal = self.normalizer.normalize_str(" ".join(texts))
        ends = np.cumsum([len(x) + 1 for x in normal.split(" ")])
        if len(ends) != len(texts):  # white space beyond ASCII inside some
            rows = [self._split(t) for t in texts]
            return [w for r in rows for w in r], np.array([len(r) for r in rows])
        found = self.splitter.pre_tokenize_str(normal)
        return [w for w, _ in found], np.bincount(np.searchsorted(ends, [at for _, (at, _) in found], "right"), minlength=len(texts))

    def words(self, stretches: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct words of ``stretches``; the words of all, end to end, as places among them; each one's number of words."""
        plain = np.array([t.isascii() and t.isprintable() for t in stretches], bool)
        marked = np.array(["<|" in t for t in stretches], bool) if self.added else np.zeros(len(stretches), bool)
        found, counts, of = [], [], []
        of.append(np.flatnonzero(plain & ~marked))
        flat = _ASCII_WORDS.findall("".join(f"{stretches[i]}\n" for i in of[0].tolist()).lower())
        ends = np.flatnonzero(np.array([w == "\n" for w in flat], bool))
        counts.append(np.diff(ends, prepend=-1) - 1)
        found += [w for w in flat if w != "\n"]
        other = np.flatnonzero(~plain & ~marked)
        for k in range(0, len(other), TOGETHER):
            of.append(other[k : k + TOGETHER])
            words, n = self._split_together([stretches[i] for i in of[-1].tolist()])
            found += words
            counts.append(n)
        of.append(np.flatnonzero(marked))
        rows = [self._alone(stretches[i]) for i in of[-1].tolist()]
        found += [w for r in rows for w in r]
        counts.append(np.array([len(r) for r in rows], np.int64))
        coded = pa.array(found, pa.large_string()).dictionary_encode()
        # back into the order of the stretches
        order, n = np.concatenate(of).astype(np.int64), np.concatenate(counts).astype(np.int64)
        starts, places = np.cumsum(n) - n, coded.indices.to_numpy()
        inverse = np.argsort(order)
        n, starts = n[inverse], starts[inverse]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return coded.dictionary, places[np.repeat(starts, n) + within], n

    def word_ids(self, words: list[str]) -> pa.Array:
        """Ids of each word (of byte letters), as little-endian numbers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        symbols = self.inner[letters]
        symbols[ends - 1] = self.last[letters[ends - 1]]
        short = sizes <= SHORT_WORD
        inside = np.repeat(short, sizes)
        symbols[inside] = merged_together(symbols[inside], np.cumsum(sizes[short]), self.pairs)
        for i in np.flatnonzero(~short).tolist():
            done = merged(symbols[ends[i] - sizes[i] : ends[i]].tolist(), self.ranks)
            symbols[ends[i] - sizes[i] : ends[i]] = np.array([*done, *[-1] * (int(sizes[i]) - len(done))])
        for i in (i for i, w in enumerate(words) if w in self.added):
            symbols[ends[i] - sizes[i] : ends[i]] = -1
            symbols[ends[i] - 1] = self.added[words[i]]
        left = symbols >= 0
        bounds = 4 * np.concatenate([[0], np.cumsum(left)[ends - 1]]) if len(words) else np.zeros(1, np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(symbols[left].astype("<u4"))])

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text (binary: little-endian unsigned 32-bit numbers)."""
        stretches, places, counts = coded_words(*utf8(texts))
        words, of, n = self.words([w.decode() for w in stretches.to_pylist()])
        ids = _joined(self.word_ids(words.to_pylist()).take(pa.array(of)), n)
        return _joined(ids.take(pa.array(places)), counts).cast(pa.binary())

    def decode(self, ids: pa.Array) -> pa.Array:
        """The text of each row of ids: token strings with spaces between them."""
        rows = [np.frombuffer(x or b"", "<u4") for x in ids.to_pylist()]
        flat = np.concatenate([*rows, np.zeros(0, "<u4")]).astype(np.int64)
        strings = self.tokens.take(pa.array(np.minimum(flat, len(self.tokens) - 1)))  # the last is null
        if strings.null_count:
            raise ValueError("an id is not in the vocabulary")
        _, ends, data = strings.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        ends, data = ends[np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])].tolist(), memoryview(data or b"")
        return pa.array([str(data[a : b - 1], "utf-8") if b > a else "" for a, b in zip(ends, ends[1:], strict=False)], pa.string())


def _joined(parts: pa.LargeBinaryArray, counts: np.ndarray) -> pa.LargeBinaryArray:
    """Each ``counts`` parts in a row as one."""
    _, ends, data = parts.buffers()
    ends = np.frombuffer(ends, np.int64)[: len(parts) + 1] if len(parts) else np.zeros(1, np.int64)
    ends = ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), data or pa.py_buffer(b"")])


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _with(df: DataFrame, source: str, result: str, kind, work: str, path: str, keep: Sequence[str] | None) -> DataFrame:
    """``df`` (of its columns those of ``keep``, or all) with ``result``, which ``work`` of the codec makes of ``source``."""
    kept = [c for c in df.columns if keep is None or c in keep]
    names = own_columns(df.select(*map(column, kept)), [result])
    fields = [StructField(names[c], df.schema[c].dataType) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = getattr(codec(path), work)
        for batch in slices(batches, "__w_source"):
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names.values()), made(batch["__w_source"])], [*names.values(), result])

    rows = df.select(*[column(c).alias(n) for c, n in names.items()], column(source).alias("__w_source"))
    return rows.mapInArrow(run, StructType([*fields, StructField(result, kind)]))


def encode(docs: DataFrame, text: str = "text", path: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``ids``: each text's token ids, as little-endian unsigned 32-bit numbers. keep: the columns that stay (all)."""
    return _with(docs, text, "ids", BinaryType(), "encode", path or vocabulary(), keep)


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ids. keep: the columns that stay (all)."""
    return _with(encoded, ids, "decoded", StringType(), "decode", path or vocabulary(), keep)
