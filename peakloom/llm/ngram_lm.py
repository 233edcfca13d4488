"""Trigram language model in an Elias-Fano trie, built and queried in parallel.

Three levels, each cut into shards of contiguous contexts that are files in the shared folder
and memory-mapped by the workers: words (their 64-bit hashes, monotone, and counts), successors
of words, and successors of pairs. In levels 2 and 3 a context's pointer range comes from a
monotone pointer sequence and its successors from a monotone key sequence (each range counted on
from the last key of the range ahead), so a look-up is a successor search relative to its
context. A context with more tokens than half a shard has shards of its own, over ranges of its
successors, and its totals are summed over them before they are built. Keys of level 3 are relative to context too: a word is its place among the successors
of the middle word, whose range is far smaller than the vocabulary. Probabilities are
interpolated by absolute discounting, with one discount a level, estimated from the counts of
counts of all its shards, and stored, like back-off weights, as 8-bit codes of 255 equal ranges
of their logarithms, between bounds that follow from the number of tokens. So scores do not
depend on how the model is cut into shards.

The unigram level is add-one over N training tokens and V distinct ones: (c + 1) / (N + V + 1).

Defined cases: null and blank texts are one end token; words that training never saw have count
0 and never extend a context; a null doc_id hashes as the empty string; repeated rows each count
and are each scored; without training rows every token has probability 1; columns besides doc_id
and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions.shared import run_dir, written
from peakloom.llm.arrow_words import hash_of, hashed_words, slices
from peakloom.llm.elias_fano import EliasFano, load, prefixed, save, stored

FOLDS, HELD_OUT = 7, 2
#: Words of a level-1 shard and training tokens of a shard of the other levels, in the mean; set task memory, not results.
WORDS_A_SHARD, TOKENS_A_SHARD = 1 << 20, 1 << 20
#: Bytes of text that are looked up at once; a task's memory follows them, results do not.
TEXT_BYTES = 3 << 20
#: Hashes of strings that cannot be words, since they hold a space.
BEGIN, END = (hash_of(x) for x in (b" begin", b" end"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


# --- levels ---------------------------------------------------------------------------------


def _codes(values: np.ndarray, low: float) -> np.ndarray:
    """Codes 1..255 of logarithms in [low, 0]."""
    return (1 + np.clip((values / low - 1) * -255, 0, 254)).astype(np.uint8) if low < 0 else np.full(len(values), 255, np.uint8)


def _book(low: float) -> np.ndarray:
    """The middle of each code's range; code 0 is 0.0."""
    book = (low * (255.5 - np.arange(256)) / 255).astype(np.float32)
    book[0] = 0.0
    return book


@dataclass(frozen=True)
class Discount:
    """A level's discount, and the least logarithms of its probabilities and back-off weights."""

    value: float
    low: float
    low_back: float

    @staticmethod
    def estimated(once: int, twice: int, n: int) -> Discount:
        d = min(0.98, max(0.1, once / (once + 2 * twice))) if once else 0.1
        return Discount(d, float(np.log10((1 - d) / max(n, 1))), float(np.log10(d / max(n, 1))))


def build_level(contexts: np.ndarray, keys: np.ndarray, counts: np.ndarray, lower: np.ndarray, first: int, end: int, discount: Discount, whole: tuple[int, int] | None = None) -> tuple[dict, dict[str, np.ndarray]]:
    """A shard of the contexts [first, end) from sorted distinct (context, key) with counts and the lower order's probabilities. ``whole``: kinds and total of a context of several shards."""
    starts = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(contexts) else np.zeros(0, np.int64)
    group = np.cumsum(np.isin(np.arange(len(contexts)), starts)) - 1
    kinds = np.diff(np.r_[starts, len(contexts)])
    totals = np.add.reduceat(counts, starts) if len(starts) else np.zeros(0, np.int64)
    if whole is not None:
        kinds, totals = np.full(1, whole[0]), np.full(1, whole[1])
    left = discount.value * kinds / totals if len(starts) else np.zeros(0)
    p = (counts - discount.value) / totals[group] + left[group] * lower
    codes = _codes(np.log10(p), discount.low)
    back = np.zeros(end - first, np.uint8)
    back[contexts[starts] - first] = _codes(np.log10(left), discount.low_back)
    last = np.r_[keys[starts[1:] - 1], keys[-1:]].astype(np.uint64)
    ahead = np.concatenate([[0], np.cumsum(last)])[:-1].astype(np.uint64) if len(starts) else np.zeros(0, np.uint64)
    monotone = keys.astype(np.uint64) + (ahead[group] if len(keys) else np.zeros(0, np.uint64))
    pointers = np.concatenate([[0], np.cumsum(np.bincount(contexts - first, minlength=end - first))])
    numbers, arrays = {"first": first, "end": end}, {"code": codes, "book": _book(discount.low), "back": back, "back_book": _book(discount.low_back)}
    for name, values in (("key", monotone), ("pointer", pointers)):
        more = prefixed(name, EliasFano.build(values))
        numbers, arrays = numbers | more[0], arrays | more[1]
    return numbers, arrays


@dataclass(frozen=True)
class Shard:
    """A file of a level: its first context and (of a context of several shards) first key, first entry, entries, and the first entry of a context of several shards (or -1)."""

    name: str
    context: int
    key: int
    entry: int
    n: int
    hot: int


class Level:
    """All shards of level 2 or 3. Contexts and entries have global numbers."""

    def __init__(self, folder: str, shards: list[Shard]) -> None:
        self.folder, self.shards = folder, shards
        self.firsts = np.array([s.context for s in shards], np.int64)
        self.keys = np.array([s.key for s in shards], np.int64)
        self.entries = np.array([s.entry for s in shards], np.int64)

    @property
    def size(self) -> int:
        return sum(s.n for s in self.shards)

    def _parts(self, cuts: np.ndarray, end: int) -> Iterator[tuple[Shard, slice]]:
        """Shards with the stretches between ``cuts``, where not empty."""
        for shard, i, j in zip(self.shards, cuts.tolist(), [*cuts[1:].tolist(), end], strict=True):
            if i < j:
                yield shard, slice(i, j)

    def ranges(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each of the sorted contexts: first entry, end, last key ahead (for the search) and log10 back-off weight."""
        begin, end, ahead, back = (np.zeros(len(contexts), k) for k in (np.int64, np.int64, np.uint64, np.float64))
        for shard, at in self._parts(np.searchsorted(contexts, self.firsts), len(contexts)):  # of several shards, the last
            numbers, arrays = load(self.folder, shard.name)
            pointer, c = stored("pointer", numbers, arrays), contexts[at] - shard.context
            inside = c < len(arrays["back"])
            c = np.where(inside, c, 0)
            b, e = (x.astype(np.int64) for x in pointer.access_two(c))
            b, e = np.where(inside, b, 0), np.where(inside, e, 0)
            begin[at], end[at] = b + shard.entry, e + shard.entry
            some = np.flatnonzero((b > 0) & (end[at] > begin[at]))
            ahead[at][some] = stored("key", numbers, arrays).access(b[some] - 1)
            back[at] = np.where(inside, arrays["back_book"][arrays["back"][c]], 0.0)
            if shard.hot >= 0:
                begin[at] = np.where(inside, shard.hot, begin[at])
        return begin, end, ahead, back

    def find(self, contexts: np.ndarray, ranges: tuple[np.ndarray, ...], of: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Entries (or -1) of keys in contexts with their ``ranges``; ``of``, sorted, is the context's place among those, and keys are sorted in each."""
        begin, end, ahead, _ = ranges
        found = np.full(len(of), -1, np.int64)
        for shard, at in self._parts(cut_places(contexts[of], keys, self.firsts, self.keys), len(of)):
            o = of[at]
            hit = stored("key", *load(self.folder, shard.name)).find(ahead[o] + keys[at].astype(np.uint64), begin[o] - shard.entry, end[o] - shard.entry)
            found[at] = np.where(hit >= 0, hit + shard.entry, -1)
        return found

    def log_p(self, entries: np.ndarray) -> np.ndarray:
        """Of sorted entries."""
        out = np.zeros(len(entries))
        for shard, at in self._parts(np.searchsorted(entries, self.entries), len(entries)):
            arrays = load(self.folder, shard.name)[1]
            out[at] = arrays["book"][arrays["code"][entries[at] - shard.entry]]
        return out

    def begins(self, entries: np.ndarray) -> np.ndarray:
        """First entry of the range that holds each of the sorted entries."""
        out = np.zeros(len(entries), np.int64)
        for shard, at in self._parts(np.searchsorted(entries, self.entries), len(entries)):
            if shard.hot >= 0:
                out[at] = shard.hot
                continue
            numbers, arrays = load(self.folder, shard.name)
            pointers = stored("pointer", numbers, arrays).decode().astype(np.int64)
            local = entries[at] - shard.entry
            out[at] = pointers[np.searchsorted(pointers, local, "right") - 1] + shard.entry
        return out


def cut_places(a: np.ndarray, b: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where the sorted bounds (first, second) cut the sorted pairs (a, b)."""
    cuts = np.searchsorted(a, first)
    for i in np.flatnonzero(second > 0).tolist():
        end = int(np.searchsorted(a, first[i], "right"))
        cuts[i] += np.searchsorted(b[cuts[i] : end], second[i])
    return cuts


class Words:
    """Level 1: shards by the high bits of the hash."""

    def __init__(self, folder: str, bits: int, sizes: list[int]) -> None:
        self.folder, self.bits, self.sizes = folder, bits, sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (or -1) and counts."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        for s in np.unique(shard).tolist():
            if self.sizes[s]:
                at = np.flatnonzero(shard == s)
                numbers, arrays = load(self.folder, f"words-{s}")
                hit = stored("key", numbers, arrays).find(hashes[at])
                known = hit >= 0
                ids[at[known]] = hit[known] + self.starts[s]
                counts[at[known]] = arrays["count"][hit[known]]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(ids), np.int64), np.searchsorted(self.starts, ids, "right") - 1
        for s in np.unique(shard).tolist():
            at = np.flatnonzero(shard == s)
            out[at] = load(self.folder, f"words-{s}")[1]["count"][ids[at] - self.starts[s]]
        return out


# --- texts ----------------------------------------------------------------------------------


@dataclass
class Tokens:
    """Tokens of some texts, each text behind a begin mark. place: of each token but the marks."""

    hashes: np.ndarray
    word: np.ndarray
    text: np.ndarray
    real: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    distinct, places, counts = hashed_words(texts)
    n, known = len(counts), len(distinct)
    word = np.full(len(places) + 2 * n, known + 1, np.int64)
    starts = np.concatenate([[0], np.cumsum(counts + 2)])[:-1].astype(np.int64)
    real = np.ones(len(word), bool)
    real[starts] = False
    inner = real.copy()
    inner[starts + counts + 1] = False
    word[starts], word[inner] = known, places
    return Tokens(np.append(distinct, np.array([BEGIN, END], np.uint64)), word, np.repeat(np.arange(n), counts + 2), real)


def _unique_pairs(a: np.ndarray, b: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (a, b) with how often, or how heavily, each occurs."""
    if not len(a):
        return a, b, np.zeros(0, np.int64)
    span = int(b.max()) + 1
    if (int(a.max()) + 1) * span < 1 << 63:
        key = a * span + b
        order = np.argsort(key, kind="stable") if weights is not None else None
        key = np.sort(key) if order is None else key[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        a, b = key[new] // span, key[new] % span
    else:
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        total, a, b = len(a), a[new], b[new]
        return a, b, np.diff(np.r_[new, total]) if weights is None else np.add.reduceat(weights[order], new)
    return a, b, np.diff(np.r_[new, len(key)]) if weights is None else np.add.reduceat(weights[order], new)


def _distinct_pairs(a: np.ndarray, b: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (a, b), all below ``span``, and the place of each pair among them."""
    if span * span < 1 << 63:
        key, inverse = np.unique(a * span + b, return_inverse=True)
        return key // span, key % span, inverse
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    inverse = np.empty(len(a), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return a[new], b[new], inverse


def _squeeze(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> bytes:
    """Sorted pairs with counts: differences of a, then b and counts, by byte planes."""
    planes = [np.diff(a, prepend=0), b, c]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in planes))


def _spread(data: bytes) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(3, 8, -1)
    a, b, c = (np.ascontiguousarray(p.T).view("<u8")[:, 0].astype(np.int64) for p in planes)
    return [np.cumsum(a), b, c]


@dataclass(frozen=True)
class Bounds:
    """Where each shard begins, in order: context, successor, and that as a key; which have a hot context of their own."""

    context: np.ndarray
    successor: np.ndarray
    key: np.ndarray
    hot: np.ndarray
    end: int

    @staticmethod
    def of(total: int, shards: int, hot: list[tuple[int, int, int, int]]) -> Bounds:
        """Equal ranges of ``total`` contexts; hot contexts (context, parts, first successor, successors) are cut out of them and into parts."""
        rows = {(x, 0): (0, False) for x in (np.arange(shards, dtype=np.int64) * total // shards).tolist()}
        for context, parts, first, kinds in hot:
            rows.setdefault((context + 1, 0), (0, False))
        for context, parts, first, kinds in hot:
            rows[context, 0] = (0, True)
            rows.update({(context, first + j * kinds // parts): (j * kinds // parts, True) for j in range(1, parts) if j * kinds // parts})
        rows = {k: v for k, v in sorted(rows.items()) if k[0] < total}
        context, successor = (np.array([k[i] for k in rows], np.int64) for i in (0, 1))
        return Bounds(context, successor, np.array([v[0] for v in rows.values()], np.int64), np.array([v[1] for v in rows.values()], bool), total)

    def ends(self, shard: int) -> int:
        """The context behind a shard's last one."""
        if self.hot[shard]:
            return int(self.context[shard]) + 1
        return int(self.context[shard + 1]) if shard + 1 < len(self.context) else self.end


def _blocks(a: np.ndarray, b: np.ndarray, c: np.ndarray, bounds: Bounds) -> pa.RecordBatch:
    """A row for each shard that has some of the sorted pairs."""
    cuts = [*cut_places(a, b, bounds.context, bounds.successor).tolist(), len(a)]
    rows = [(s, _squeeze(a[i:j], b[i:j], c[i:j])) for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j]
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["shard", "block"])


def _merged(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [_spread(x) for x in blocks["block"].to_pylist()]
    return _unique_pairs(*[np.concatenate([p[i] for p in parts]) for i in range(3)])


_MERGED = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("once", pa.int64()), ("twice", pa.int64()), ("hot", pa.binary()), ("block", pa.binary())])


# --- the model ------------------------------------------------------------------------------


@dataclass
class NgramModel:
    """Where the trie's files are, and N and V of training."""

    folder: str
    n: int
    v: int
    words: Words
    pairs: Level
    triples: Level

    def log_unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.n + self.v + 1))

    def ids(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.words.look_up(t.hashes)
        return ids[t.word], counts[t.word]

    def neighbours(self, t: Tokens, ids: np.ndarray) -> np.ndarray:
        """Which tokens have, with the token ahead of them in their text, a pair of known words."""
        return np.flatnonzero(t.real[1:] & (ids[1:] >= 0) & (ids[:-1] >= 0)) + 1

    def nodes(self, t: Tokens, ids: np.ndarray) -> Nodes:
        at = np.flatnonzero(t.real[1:] & (ids[:-1] >= 0)) + 1
        span = int(self.words.starts[-1]) + 1  # the last key stands for unknown words, which no context has
        first, second, inverse = _distinct_pairs(ids[at - 1], np.where(ids[at] >= 0, ids[at], span - 1), span)
        new = np.diff(first, prepend=-1) > 0
        of, contexts = np.cumsum(new) - 1, first[new]
        ranges = self.pairs.ranges(contexts)
        entry = self.pairs.find(contexts, ranges, of, second)
        which = np.full(len(ids), -1, np.int64)
        which[at] = inverse
        return Nodes(which, entry, ranges[0][of], ranges[3][of])

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        t = tokens(texts)
        ids, counts = self.ids(t)
        low = self.log_unigram(counts)
        total = low.copy()
        if self.n:
            nodes = self.nodes(t, ids)
            at = np.flatnonzero(nodes.which >= 0)
            pair = nodes.which[at]
            seen = nodes.entry >= 0
            p = np.zeros(len(seen))
            p[seen] = self.pairs.log_p(nodes.entry[seen])
            total[at] = np.where(seen[pair], p[pair], total[at] + nodes.back[pair])
            # contexts of level 3 are the entries found in level 2, which are sorted
            context, place = nodes.entry[seen], np.cumsum(seen) - 1
            ranges = self.triples.ranges(context)
            at = at[seen[nodes.which[at - 1]] & (nodes.which[at - 1] >= 0)]
            of = place[nodes.which[at - 1]]
            total[at] += ranges[3][of]
            after = nodes.which[at]
            both = np.flatnonzero(seen[after] & (ranges[0] < ranges[1])[of])
            if len(both):
                key = (nodes.entry - nodes.begin)[after[both]]
                span = int(key.max()) + 1
                triple, inverse = np.unique(of[both] * span + key, return_inverse=True)
                hit = self.triples.find(context, ranges, triple // span, triple % span)
                good = hit >= 0
                p = np.zeros(len(hit))
                p[good] = self.triples.log_p(hit[good])
                total[at[both]] = np.where(good[inverse], p[inverse], total[at[both]])
        n = len(texts)
        add = lambda x: np.bincount(t.text[t.real], weights=x[t.real], minlength=n)
        return {"n_tokens": add(np.ones(len(ids))).astype(np.int64), "n_known": add(counts > 0).astype(np.int64), "base_score": add(low), "score": add(total)}


@dataclass
class Nodes:
    """Distinct pairs of adjacent tokens, sorted. which: each token's pair with the one ahead (-1 if that is unknown); entry in level 2 (or -1), begin of its context's range, back-off weight of the context."""

    which: np.ndarray
    entry: np.ndarray
    begin: np.ndarray
    back: np.ndarray


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=TEXT_BYTES):
        t = tokens(batch["text"])
        counts = np.bincount(t.word[t.real], minlength=len(t.hashes))
        yield pa.RecordBatch.from_arrays([pa.array(t.hashes.view(np.int64)), pa.array(counts)], ["h", "c"])


def train(docs: DataFrame) -> NgramModel:
    """Model of all rows of ``docs`` (text). Files stay in the shared folder."""
    folder = run_dir(docs.sparkSession, "ngram-trie")
    docs = docs.select("text")
    words = written(docs.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "vocabulary")
    size = words.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, v = int(size["n"]), int(size["v"])
    bits = max(0, (size["rows"] // WORDS_A_SHARD).bit_length())

    def word_shard(key: tuple, table: pa.Table) -> pa.Table:
        h, c = table["h"].to_numpy().view(np.uint64), table["c"].to_numpy()
        order = np.argsort(h)
        numbers, arrays = prefixed("key", EliasFano.build(h[order]))
        save(folder, f"words-{key[0].as_py()}", numbers, arrays | {"count": c[order]})
        return pa.table({"shard": [key[0].as_py()], "n": [len(h)]}, schema=pa.schema([("shard", pa.int64()), ("n", pa.int64())]))

    high = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0)
    rows = words.withColumn("shard", high.cast("long")).groupBy("shard").applyInArrow(word_shard, "shard long, n long").collect()
    sizes = {r["shard"]: r["n"] for r in rows}
    model = NgramModel(folder, n, v, Words(folder, bits, [sizes.get(s, 0) for s in range(1 << bits)]), Level(folder, []), Level(folder, []))
    if not n:
        return model
    shards = max(1, -(-n // TOKENS_A_SHARD))
    heavy, n_words = TOKENS_A_SHARD // 2, int(model.words.starts[-1])
    parts = lambda c: -(-2 * c // TOKENS_A_SHARD)

    def level(name: str, count, lower, bounds: Bounds) -> tuple[Level, list[tuple[int, int, int]]]:
        """Merge each shard's blocks, sum over all of them what is not of one shard, then build each where its merged block lies. Also the heavy entries: entry, successor, count."""

        def merge(key: tuple, blocks: pa.Table) -> pa.Table:
            a, b, c = _merged(blocks)
            at = np.flatnonzero(c > heavy)
            hot = np.stack([at, b[at], c[at]]).astype("<i8").tobytes()
            return pa.table({"shard": [key[0].as_py()], "n": [len(a)], "total": [int(c.sum())], "once": [int((c == 1).sum())], "twice": [int((c == 2).sum())], "hot": [hot], "block": [_squeeze(a, b, c)]}, schema=_MERGED)

        counted = docs.mapInArrow(count, "shard long, block binary").repartition(len(bounds.context), "shard")
        merged = written(counted.groupBy("shard").applyInArrow(merge, "shard long, n long, total long, once long, twice long, hot binary, block binary"), f"{name}-merged")
        rows = sorted(merged.drop("block").collect(), key=lambda r: r["shard"])
        discount = Discount.estimated(sum(r["once"] for r in rows), sum(r["twice"] for r in rows), n)
        files, whole, found, at = [], {}, [], 0
        for r in rows:
            s, context = r["shard"], int(bounds.context[r["shard"]])
            if bounds.hot[s]:
                begin, kinds, total = whole.get(context, (at, 0, 0))
                whole[context] = begin, kinds + r["n"], total + r["total"]
            files.append(Shard(f"{name}-{s}", context, int(bounds.key[s]), at, r["n"], whole[context][0] if bounds.hot[s] else -1))
            found += [(at + i, b, c) for i, b, c in np.frombuffer(r["hot"], "<i8").reshape(3, -1).T.tolist()]
            at += r["n"]

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, block in zip(batch["shard"].to_pylist(), batch["block"], strict=True):
                    a, b, c = _spread(block.as_py())
                    below, keys = lower(a, b)
                    first = int(bounds.context[shard])
                    save(folder, f"{name}-{shard}", *build_level(a, keys, c, below, first, bounds.ends(shard), discount, whole[first][1:] if bounds.hot[shard] else None))
                    yield pa.RecordBatch.from_arrays([pa.array([shard])], ["shard"])

        merged.select("shard", "block").mapInArrow(build, "shard long").write.format("noop").mode("overwrite").save()
        return Level(folder, files), found

    # heavy words as contexts; the begin mark stands ahead of as many tokens as there are end marks
    often = words.where(F.col("c") > heavy).select("h", "c").collect()
    followed = {r["h"] & (1 << 64) - 1: r["c"] for r in often}
    if END in followed:
        followed[BEGIN] = followed.pop(END)
    hashes = np.array(sorted(followed), np.uint64)
    hot = [(i, parts(followed[h]), 0, n_words) for i, h in zip(model.words.look_up(hashes)[0].tolist(), hashes.tolist(), strict=True)]
    by_word = Bounds.of(n_words, shards, hot)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=TEXT_BYTES):
            t = tokens(batch["text"])
            ids = model.ids(t)[0]
            at = model.neighbours(t, ids)
            yield _blocks(*_unique_pairs(ids[at - 1], ids[at]), by_word)

    def unigram(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, inverse = np.unique(b, return_inverse=True)
        return ((model.words.counts(distinct) + 1) / (n + v + 1))[inverse], b

    pairs, heavy_pairs = level("pairs", count_pairs, unigram, by_word)
    ready = NgramModel(folder, n, v, model.words, pairs, Level(folder, []))
    middle = np.array(sorted({b for _, b, _ in heavy_pairs}), np.int64)
    begin, end = (x.tolist() for x in pairs.ranges(middle)[:2])
    follow = {m: (i, j - i) for m, i, j in zip(middle.tolist(), begin, end, strict=True)}
    by_pair = Bounds.of(pairs.size, shards, [(entry, parts(c), *follow[b]) for entry, b, c in heavy_pairs if follow[b][1]])

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=TEXT_BYTES):
            t = tokens(batch["text"])
            nodes = ready.nodes(t, ready.ids(t)[0])
            node = np.where(nodes.which >= 0, nodes.entry[nodes.which], -1)
            at = np.flatnonzero(t.real[1:] & (node[:-1] >= 0) & (node[1:] >= 0)) + 1
            yield _blocks(*_unique_pairs(node[at - 1], node[at]), by_pair)

    def bigram(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, inverse = np.unique(b, return_inverse=True)
        return (10 ** pairs.log_p(distinct))[inverse], b - pairs.begins(distinct)[inverse]

    ready.triples = level("triples", count_triples, bigram, by_pair)[0]
    return ready


def score(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    model = train(rows.where("not held_out"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=TEXT_BYTES):
            s = model.score(batch["text"])
            cols = [batch["doc_id"], batch["held_out"], pa.array(s["n_tokens"]), pa.array(s["n_known"]), pa.array(np.full(batch.num_rows, model.n, np.int64)), pa.array(s["base_score"]), pa.array(s["score"])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
