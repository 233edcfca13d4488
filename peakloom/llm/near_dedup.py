"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets are one class. Classes branch recursively: a
tree's node picks one of the minwise tokens (at times two, so that a pair at the threshold stays
together once a level in the mean) and its documents go to the child of their own value. Small
nodes are compared exhaustively. Trees are independent and repeated: a pair at the threshold
stays together less often the deeper its nodes are, so documents in nodes below level SHALLOW get
as many further trees as their deepest level needs for all trees to miss such a pair at most
TREE_MISS of the time. From there on nodes of up to DENSE_TASK documents branch no further. Large
nodes that branching hardly splits (groups of near copies: a share DENSE of the parent's documents
agree) are compared whole, too.

Comparing means agreeing minwise tokens first. A node hands on only a forest of its candidate
pairs, those that agree most; every link is confirmed on full shingle sets, first the best of
each document, then those between components that are still apart. Where candidates beside a
node's forest could still connect something, its sets meet in tiles of bounded size, where the
intersections of all pairs across components are counted at once by products of matrices, each pair
in the first node that it shares. The largest nodes are dealt to blocks that are compared so;
a few leaders, compared with all members of other components, connect the blocks ahead of the
tiles. So no member is capped or left out, and components are those of all links.

Defined cases: null and blank texts have empty sets and are linked with nothing; texts of fewer
words than a shingle have their whole sequence as their one element; rows that repeat a doc_id
are judged by their own text; a null doc_id gets a null component unless its class has an id;
empty tables give empty results; columns besides doc_id and text are not read. Of the rows of a
component ``keep_one_of_each`` keeps one of the smallest doc_id, repeated rows and null ids (which
come last) included.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions.shared import written
from peakloom.llm.arrow_words import hashed_words, mixed, slices
from peakloom.operators.components import connected_components

SHINGLE, PERCENT = 5, 85
#: Minwise tokens a document, and documents in a node that is compared exhaustively.
TOKENS, LEAF = 64, 256
#: A large node that kept this share of its parent is dense; up to so many documents, one task finds its forest.
DENSE, DENSE_TASK = 0.85, 2048
#: Bytes of sets on a side of a tile.
TILE_BYTES = 8 << 20
#: Pairs at the threshold fail the filter of agreeing tokens at most so often, and all their trees at most so often.
FILTER_MISS, TREE_MISS = 1 / 30_000, 1 / 1000
#: All documents get the trees that nodes of this level need.
SHALLOW = 4
#: Rows and columns of the products by which sets meet in a tile; bound memory.
ROWS, COLUMNS = 256, 4096
#: Leaders of a larger dense node.
LEADERS = 4
#: Bits of the filter that keeps texts without candidates from being shuffled. Its size is fixed; hits that it lets through by chance are joined away.
FILTER_BITS = 1 << 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _agreeing(percent: int) -> list[float]:
    """Chance of each number of agreeing tokens, for a pair at the threshold."""
    s = percent / 100
    return [math.comb(TOKENS, a) * s**a * (1 - s) ** (TOKENS - a) for a in range(TOKENS + 1)]


@functools.lru_cache(maxsize=16)
def agree(percent: int) -> int:
    """A pair is confirmed on full sets if so many of its TOKENS agree."""
    below = itertools.accumulate(_agreeing(percent))
    return next(a for a, p in enumerate(below) if p > FILTER_MISS)


def second(percent: int) -> float:
    """Chance of a second branch: a pair at the threshold has one common child a level in the mean."""
    return 100 / percent - 1


def together(share: float, percent: int, level: int) -> float:
    """Chance that a pair with ``share`` of its tokens in common is in one node of a tree's ``level``."""
    gone, two = 0.0, second(percent)
    for _ in range(level):
        apart = 1 - share + share * gone
        gone = (1 - two) * apart + two * apart**2
    return share * (1 - gone)


@functools.lru_cache(maxsize=512)
def trees(level: int, percent: int) -> int:
    """The least number of trees of which a pair at the threshold misses all TREE_MISS of the time, if nodes are compared at ``level``."""
    chances = [(p, together(a / TOKENS, percent, level)) for a, p in enumerate(_agreeing(percent)) if a >= agree(percent)]
    enough = lambda n: sum(p * (1 - q) ** n for p, q in chances) <= TREE_MISS
    high = 1
    while not enough(high):
        high *= 2
    return bisect.bisect_left(range(high + 1), True, lo=1, key=enough)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes (64 bits)."""
    distinct, places, counts = hashed_words(texts)
    words = distinct[places]
    ends = np.cumsum(counts)
    rolled = np.zeros(max(0, len(words) - shingle + 1), np.uint64)
    for i in range(shingle):
        rolled = mixed(rolled * _MIX + words[i : i + len(rolled)])
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= shingle:
            out.append(np.unique(rolled[end - n : end - shingle + 1]))
        elif n:
            h = np.array([n], np.uint64)
            for w in words[end - n : end]:
                h = mixed(h * _MIX + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.astype("<u8").tobytes(), digest_size=16).digest()


def minwise(sets: list[np.ndarray], tokens: int = TOKENS) -> np.ndarray:
    """Minwise tokens of non-empty sets, one row each (int32)."""
    state = np.random.RandomState(17)
    a = state.randint(0, 1 << 62, tokens).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    b = state.randint(0, 1 << 62, tokens).astype(np.uint64)
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), tokens), np.uint32)
    for k in range(tokens):
        out[:, k] = np.minimum.reduceat(((flat * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out.view(np.int32)


def _sketch(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = shingle_sets(batch["text"], shingle)
        full = [s for s in sets if len(s)]
        tokens = iter(minwise(full) if full else ())
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                batch["t"],
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([next(tokens).tolist() if len(s) else None for s in sets], pa.list_(pa.int32())),
            ],
            ["doc_id", "t", "n", "k", "sig"],
        )


def pack(values: np.ndarray) -> bytes:
    return values.astype("<u8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _slot(rep: Column) -> Column:
    return F.pmod(F.xxhash64(rep), F.lit(FILTER_BITS)) + 1


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()


def _sets_of(docs: DataFrame, ends: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """(rep, set) for every class of ``ends``, out of the texts; a fixed-size filter of their least ids goes ahead of the shuffle."""
    wanted = written(reps.select("rep", "k", F.coalesce("least", F.lit(-1)).alias("id")).join(ends, "rep", "left_semi"), "wanted-sets")
    p = _slot(F.col("id"))
    rows = wanted.groupBy(F.bitmap_bucket_number(p).alias("g")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("bits")).collect()
    seen = docs.sparkSession.sparkContext.broadcast({r["g"]: bytes(r["bits"]) for r in rows})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {g: np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little") for g, bits in seen.value.items()}
        for batch in slices(batches):
            place = batch["p"].to_numpy(zero_copy_only=False) - 1
            hit = np.array([(f := filters.get(g + 1)) is not None and bool(f[i]) for g, i in zip((place // 32768).tolist(), (place % 32768).tolist(), strict=True)], bool)
            if not hit.any():
                continue
            batch = batch.filter(pa.array(hit))
            sets = shingle_sets(batch["text"], shingle)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([pack(s) for s in sets], pa.binary())], ["id", "k", "set"])

    own = F.coalesce(F.col("doc_id"), F.lit(-1))
    found = docs.select(own.alias("id"), "text", _slot(own).alias("p")).mapInArrow(fetch, "id long, k binary, set binary")
    return found.join(wanted, ["id", "k"]).dropDuplicates(["rep"]).select("rep", "set")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(unpack(x), unpack(y), percent) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    wide = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b")
    return wide.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _agreement(sig: np.ndarray, n: np.ndarray, i: int, least: int, percent: int) -> np.ndarray:
    """Agreeing tokens of each document with the i-th, 0 where they cannot be a candidate pair."""
    w = (sig == sig[i]).sum(1)
    w[(w < least) | (np.minimum(n, n[i]) * 100 < np.maximum(n, n[i]) * percent)] = 0
    w[i] = 0
    return w


def forest(sig: np.ndarray, n: np.ndarray, percent: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """The candidate pairs (with their agreement) that connect a node's candidates with most agreement, and each document's number of candidates."""
    m, least = len(n), agree(percent)
    best, via, outside, degree, found, i = np.full(m, -1), np.zeros(m, np.int64), np.ones(m, bool), np.zeros(m, np.int64), [], 0
    for _ in range(m):
        outside[i] = False
        w = _agreement(sig, n, i, least, percent)
        degree[i] = np.count_nonzero(w)
        better = outside & (w > 0) & (w > best)
        best[better], via[better] = w[better], i
        i = int(np.where(outside, best, -2).argmax())
        if outside[i] and best[i] > 0:
            found.append((int(via[i]), i, int(best[i])))
    return found, degree


def _node_pairs(percent: int):
    """Rows (node, a, b, w): a node's forest, and, without b, its members that have candidates beside the forest."""
    least = agree(percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by node; a node's rows may be cut by a batch's end."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            node = table["node"].to_numpy()
            cut = int(np.searchsorted(node, node[-1])) if len(node) else 0
            rest = table.slice(cut)
            if cut:
                yield one(table.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield one(rest)

    def one(table: pa.Table) -> pa.RecordBatch:
        node, rep, n = (table[c].to_numpy() for c in ("node", "rep", "n"))
        sig = np.asarray(table["sig"].combine_chunks().flatten()).reshape(-1, TOKENS)
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        sizes = np.diff(np.r_[starts, len(node)])
        rows: list[tuple[int, int, int | None, int]] = []
        for size in np.unique(sizes[sizes > 1]).tolist():
            at = starts[sizes == size]
            if size <= LEAF:
                at = single(rows, node, rep, n, sig, at, size)
            for k in at.tolist():
                part = slice(k, k + size)
                pairs, degree = forest(sig[part], n[part], percent)
                rows += [(node[k], min(rep[k + x], rep[k + y]), max(rep[k + x], rep[k + y]), w) for x, y, w in pairs]
                if degree.sum() > 2 * len(pairs):
                    rows += [(node[k], rep[k + x], None, 0) for x in np.flatnonzero(degree).tolist()]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["node", "a", "b", "w"])

    def single(rows: list, node, rep, n, sig, at: np.ndarray, size: int) -> np.ndarray:
        """Add the pairs of nodes (of equal size) that have one candidate pair; the starts of those that have more."""
        i, j = np.triu_indices(size, 1)
        step, more = max(1, 100_000 // len(i)), []
        for k in range(0, len(at), step):
            x, y = (np.add.outer(at[k : k + step], q).ravel() for q in (i, j))
            ok = np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent
            x, y = x[ok], y[ok]
            w = (sig[x] == sig[y]).sum(1)
            ok = w >= least
            x, y, w = x[ok], y[ok], w[ok]
            of, first, count = np.unique(node[x], return_index=True, return_counts=True)
            alone = first[count == 1]
            rows += zip(node[x[alone]].tolist(), np.minimum(rep[x[alone]], rep[y[alone]]).tolist(), np.maximum(rep[x[alone]], rep[y[alone]]).tolist(), w[alone].tolist(), strict=True)
            more.append(at[k : k + step][np.isin(node[at[k : k + step]], of[count > 1])])
        return np.concatenate(more)

    return compare


class Overlaps:
    """Sizes of the intersections of many sets.

    An element that only one set has counts for none. Elements of many sets are columns of a dense
    matrix, whose products give their part of all intersections; those of few are walked by their sets.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = len(sets)
        flat, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(self.n), [len(s) for s in sets])
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        many = count > max(8, self.n // 32)
        few = (count > 1) & ~many
        dense = many[column]
        place = np.cumsum(many) - 1
        self.dense = np.zeros((self.n, int(many.sum())), np.bool_)
        self.dense[owner[dense], place[column[dense]]] = True
        # the other shared elements, by their sets and the other way round
        light = few[column]
        place = np.cumsum(few) - 1
        of, owner = place[column[light]], owner[light]
        by = np.argsort(of, kind="stable")
        self.members, self.starts = owner[by], np.concatenate([[0], np.cumsum(count[few])])
        self.own, self.first = of, np.searchsorted(owner, np.arange(self.n + 1))

    def rows(self, some: np.ndarray) -> np.ndarray:
        """The intersections of the sets ``some`` with all others."""
        both = np.zeros((len(some), self.n), np.float32)
        for c in range(0, self.dense.shape[1], COLUMNS):
            part = self.dense[:, c : c + COLUMNS].astype(np.float32)
            both += part[some] @ part.T
        out = both.astype(np.int64)
        for row, i in zip(out, some.tolist(), strict=True):
            own = self.own[self.first[i] : self.first[i + 1]]
            if len(own):
                size = self.starts[own + 1] - self.starts[own]
                at = np.arange(size.sum()) + np.repeat(self.starts[own] - np.cumsum(size) + size, size)
                row += np.bincount(self.members[at], minlength=self.n)
        return out


def linked_in(sets: list[np.ndarray], label: np.ndarray, percent: int, side: np.ndarray | None = None, earlier: list[list[int]] | None = None) -> tuple[list[tuple[int, int]], int]:
    """Links that connect the components ``label`` of ``sets`` (all pairs between them, those between two sides if ``side`` is given), and the number of pairs judged. Pairs that share an ``earlier`` node are judged there."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    places: dict[int, int] = {}
    at = [(i, places.setdefault(x, len(places))) for i, nodes in enumerate(earlier or []) for x in nodes]
    inside = np.zeros((n, len(places)), np.float32)
    if at:
        inside[tuple(np.array(at).T)] = 1

    def open_to(some: np.ndarray) -> np.ndarray:
        ok = label[None, :] != label[some, None]
        if side is not None:
            ok &= side[None, :] != side[some, None]
        return ok & (inside[some] @ inside.T == 0) if at else ok

    some = np.flatnonzero(label != np.bincount(label).argmax()) if n else np.zeros(0, np.int64)
    wanted = np.concatenate([np.zeros(0, np.int64), *(part[open_to(part).any(1)] for part in (some[k : k + ROWS] for k in range(0, len(some), ROWS)))])
    found, judged, done = [], 0, np.zeros(n, bool)
    overlaps = Overlaps(sets) if len(wanted) else None
    for k in range(0, len(wanted), ROWS):
        part = wanted[k : k + ROWS]
        ok, both = open_to(part), overlaps.rows(part)
        close = 100 * both >= percent * (sizes[None, :] + sizes[part, None] - both)
        for i, own, linked in zip(part.tolist(), ok, close, strict=True):
            own &= ~done
            done[i] = True
            judged += int(np.count_nonzero(own))
            for j in np.flatnonzero(own & linked).tolist():
                if label[i] != label[j]:
                    label[label == label[i]] = label[j]
                    found.append((i, j))
    return found, judged


def _tile_links(percent: int):
    """Links that connect a tile's components, between its two sides or inside its one."""

    def link(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        node, rep, of, block = (table[c].to_numpy() for c in ("node", "rep", "component", "block"))
        earlier = [[x for x in nodes if x < here] for nodes, here in zip(table["nodes"].to_pylist(), node.tolist(), strict=True)]
        label = np.unique(of, return_inverse=True)[1]
        found, _ = linked_in([unpack(s) for s in table["set"].to_pylist()], label, percent, block if key[1] != key[2] else None, earlier)
        return pa.table({"a": pa.array([rep[i] for i, _ in found], pa.int64()), "b": pa.array([rep[j] for _, j in found], pa.int64())})

    return link


def _tiled(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame | None:
    """Links inside nodes (node, rep) that still have several components: their sets are dealt to blocks, and every two blocks meet. Two documents that are in several nodes are judged in the first of them."""
    named = members.join(labels.withColumnsRenamed({"node": "rep"}), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    apart = written(named.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("node"), "open-nodes")
    named = written(named.join(apart, "node", "left_semi").distinct().join(sets.select("rep", F.octet_length("set").alias("bytes")), "rep"), "open-members")
    if named.isEmpty():
        return None
    nodes = written(named.groupBy("rep").agg(F.collect_list("node").alias("nodes")), "nodes-of-members")  # as many as trees reach
    blocks = written(named.groupBy("node").agg(F.ceil(F.sum("bytes") / TILE_BYTES).alias("blocks")), "open-sizes")
    dealt = named.join(blocks, "node").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = dealt.select("node", "rep", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    at_hand = tiles.join(nodes, "rep").join(sets, "rep")
    return at_hand.groupBy("node", "i", "j").applyInArrow(_tile_links(percent), "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """``labels`` (node, component) with the links among ``pairs`` (a, b, w): the best of each document is confirmed first, then those between components that are still apart."""
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other"), "w").union(pairs.select("b", "a", "w"))
    order = F.struct("w", F.xxhash64(F.least("rep", "other"), F.greatest("rep", "other")).alias("h"), "other")
    best = ends.groupBy("rep").agg(F.max(order).alias("x")).select(F.least("rep", "x.other").alias("a"), F.greatest("rep", "x.other").alias("b")).distinct()
    best = written(best, "best-pairs")
    as_edges = lambda labels: labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    edges = _confirm(best, sets, percent)
    labels = written(connected_components(written(edges if labels is None else edges.union(as_edges(labels)), "edges")), "labels")
    rest = pairs.join(best, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    rest = written(rest.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b").distinct(), "rest-pairs")
    if rest.isEmpty():
        return labels
    return written(connected_components(written(_confirm(rest, sets, percent).union(as_edges(labels)), "edges")), "labels")


def _branch(nodes: DataFrame, reps: DataFrame, level: int, percent: int) -> DataFrame:
    """Children (node, rep, parent) of ``nodes``: all documents of a node branch by the same tokens. parent: its number of documents."""
    pick = lambda salt: F.pmod(F.xxhash64("node", F.lit(level), F.lit(salt)), F.lit(TOKENS)).cast("int")
    child = lambda c: F.xxhash64("node", c, F.get("sig", c))
    twice = F.pmod(F.xxhash64("node", F.lit(level), F.lit("twice")), F.lit(1000)) < int(second(percent) * 1000)
    wide = nodes.join(reps.select("rep", "sig"), "rep")
    children = F.when(twice, F.array_distinct(F.array(child(pick("one")), child(pick("two"))))).otherwise(F.array(child(pick("one"))))
    return wide.select("rep", F.col("c").alias("parent"), F.explode(children).alias("node"))


def _grown(nodes: DataFrame, reps: DataFrame, percent: int, name: str) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Leaves and dense nodes below the roots ``nodes``, and each level's documents (rep, level) whose nodes branched into it."""
    leaves, dense, deep, level = [], [], [], 0
    while True:
        sizes = written(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), f"sizes{name}-{level}")
        sized = written(nodes.join(sizes, "node").select("node", "rep", "c", "parent"), f"nodes{name}-{level}")
        leaves.append(sized.where(F.col("c") <= LEAF))
        large = sized.where(F.col("c") > LEAF)
        if large.isEmpty():
            return leaves, dense, deep
        whole = F.coalesce(F.col("c") >= DENSE * F.col("parent"), F.lit(False))
        if level >= SHALLOW:  # deeper levels would need more trees
            whole |= F.col("c") <= DENSE_TASK
        dense.append(large.where(whole).select("node", "rep", "c"))
        level += 1
        branching = large.where(~whole)
        deep.append(branching.select("rep", F.lit(level).alias("level")))
        nodes = _branch(branching, reps, level, percent)


def _more_roots(deep: DataFrame, reps: DataFrame, base: int, percent: int) -> DataFrame | None:
    """Roots of further trees for documents in deep nodes, as many as a document's deepest level needs."""
    reached = deep.groupBy("rep").agg(F.max("level").alias("level")).where(F.col("level") > SHALLOW)
    reached = written(reached, "depths")
    deepest = reached.agg(F.max("level")).first()[0]
    if deepest is None:
        return None
    wanted = F.array(*[F.lit(trees(d, percent)) for d in range(deepest + 1)])
    own = reached.withColumn("wanted", F.get(wanted, F.col("level"))).where(F.col("wanted") > base)
    rows = own.join(reps.select("rep", "sig"), "rep").withColumn("t", F.explode(F.sequence(F.lit(base), F.col("wanted") - 1)))
    return rows.select("rep", F.lit(None).cast("long").alias("parent"), F.xxhash64("t", F.get("sig", F.pmod(F.col("t") * 37, F.lit(TOKENS)))).alias("node"))


def _leader_pairs(dense: DataFrame, reps: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b, w) of a few leaders of every node that is not connected yet, of its smaller components first, with all its members of other components."""
    named = dense.join(labels.withColumnsRenamed({"node": "rep"}), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = written(named.groupBy("node", "component").agg(F.count(F.lit(1)).alias("c")), "dense-sizes")
    apart = sizes.groupBy("node").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("node")
    named = written(named.join(apart, "node", "left_semi").join(sizes, ["node", "component"]), "dense-nodes")
    order = F.struct("c", F.xxhash64("rep").alias("h"), "rep", "component")
    leaders = named.groupBy("node", F.pmod(F.xxhash64("rep"), F.lit(LEADERS)).alias("slot")).agg(F.min(order).alias("l"))
    leaders = written(leaders.select("node", F.col("l.rep").alias("leader"), F.col("l.component").alias("of")), "leaders")
    pairs = named.join(leaders, "node").where("component <> of").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    tokens = lambda end: reps.select(F.col("rep").alias(end), F.col("sig").alias(f"sig_{end}"), F.col("n").alias(f"n_{end}"))
    pairs = pairs.join(tokens("a"), "a").join(tokens("b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    same = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x))
    return written(pairs.withColumn("w", same).where(F.col("w") >= agree(percent)).select("a", "b", "w"), "leader-pairs")


def _judged(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """One row a document: doc_id, t (hash of the text), n, class_id (null for empty sets), component_id (the least doc_id of its component)."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    sketched = written(docs.mapInArrow(lambda it: _sketch(it, shingle), "doc_id long, t long, n long, k binary, sig array<int>"), "sketches")
    # aggregates are tables of their own ahead of joins on their key, so that Spark can split the rows of a hot key
    reps = sketched.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("least"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"))
    reps = written(reps.withColumn("rep", F.xxhash64("k")), "classes")

    base = trees(SHALLOW, percent)
    first = [F.xxhash64(F.lit(t), F.get("sig", F.lit(t * TOKENS // base))) for t in range(base)]
    roots = reps.select("rep", F.lit(None).cast("long").alias("parent"), F.explode(F.array(*first)).alias("node"))
    leaves, dense, deep = _grown(roots, reps, percent, "")
    if deep:
        roots = _more_roots(functools.reduce(DataFrame.union, deep), reps, base, percent)
        if roots is not None:
            for found, more in zip((leaves, dense), _grown(roots, reps, percent, "-deep"), strict=False):
                found.extend(more)
    small, large = functools.reduce(DataFrame.union, leaves).select("node", "rep"), None
    if dense:
        dense = written(functools.reduce(DataFrame.union, dense).distinct(), "dense")
        # larger nodes are dealt to blocks, whose forests come first; leaders connect what is left between blocks
        blocks = F.ceil(F.col("c") / DENSE_TASK)
        block = F.when(blocks > 1, F.xxhash64("node", F.pmod(F.xxhash64("rep"), blocks))).otherwise(F.col("node"))
        small = small.union(dense.select(block.alias("node"), "rep"))
        large = dense.where(blocks > 1).select("node", "rep")
        parts = written(dense.where(blocks > 1).select(block.alias("node")).distinct(), "blocks")
    filled = small.join(reps.select("rep", "n", "sig"), "rep").repartition("node").sortWithinPartitions("node", "rep")
    compared = written(filled.select("node", "rep", "n", "sig").mapInArrow(_node_pairs(percent), "node long, a long, b long, w int"), "candidates")
    pairs = written(compared.where("b is not null").groupBy("a", "b").agg(F.max("w").alias("w")), "forests")
    ends = _ends(pairs)
    if large is not None:
        ends = ends.union(large.select("rep")).distinct()
    sets = written(_sets_of(docs, ends, reps, shingle), "sets")
    labels = _linked(pairs, sets, None, percent)
    open_members = compared.where("b is null").select("node", F.col("a").alias("rep"))
    if large is not None and not large.isEmpty():
        open_members = open_members.join(parts, "node", "left_anti")  # their nodes are open as a whole
        pairs = _leader_pairs(large, reps, labels, percent)
        labels = labels if pairs.isEmpty() else _linked(pairs, sets, labels, percent)
        open_members = open_members.union(large)
    more = _tiled(open_members, sets, labels, percent)
    if more is not None:
        edges = more.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        labels = written(connected_components(written(edges, "edges")), "labels")
    named = reps.select("k", "rep", "least").join(labels.withColumnsRenamed({"node": "rep"}), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = written(named, "named-classes")
    ids = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    named = written(named.join(ids, "component").select(F.col("k").alias("class"), "component", "component_id"), "classes-of-components")
    out = sketched.select("doc_id", "t", "n", "k").join(named, F.col("k") == F.col("class"), "left")
    return out.select("doc_id", "t", "n", F.col("component").alias("class_id"), F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    out = _judged(docs, shingle, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, of its smallest doc_id; rows with empty sets all stay."""
    judged = written(_judged(docs, shingle, percent).where("class_id is not null"), "near-duplicates")
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("i"), "t")
    kept = written(judged.groupBy("class_id").agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "kept-rows")
    rows = judged.join(kept, "class_id").select(order.alias("mine"), "o", F.col("doc_id").alias("__n_id"), F.col("t").alias("__n_t"))
    gone = written(rows.where("mine <> o").select("__n_id", "__n_t").distinct(), "gone-rows")
    twice = rows.where("mine = o").groupBy("__n_id", "__n_t").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("__n_id", "__n_t")
    twice = written(twice, "repeated-rows")
    at = lambda keys: F.col("doc_id").eqNullSafe(keys["__n_id"]) & (F.xxhash64("text") == keys["__n_t"])
    out = docs.join(gone, at(gone), "left_anti")
    if twice.isEmpty():
        return out
    single = docs.join(twice, at(twice), "left_semi").withColumn("__n_t", F.xxhash64("text")).dropDuplicates(["doc_id", "__n_t"]).drop("__n_t")
    return out.join(twice, at(twice), "left_anti").union(single)
