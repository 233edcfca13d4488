"""How filters interact: every order of them, by a walk of adjacent transpositions.

Spark reduces the documents to cells: how many rows of a part fail exactly which filters, with
labels. A part has at most 2^filters cells, whatever its rows. The walk visits all orders so that
each differs from the one before by a swap of neighbours; a swap changes what the two swapped
steps remove and nothing else, so only those two are summed from the cells again, for all parts of
a batch at once. A filter's Shapley sum gathers what it removes in each order along the way.

A copy is found by a digest of its text: the least doc_id of each text that several rows have is a
table of its own, joined back to the rows, so that Spark can split a text that many rows share.

Defined cases: null and empty texts are the empty text (and copies of each other); a null doc_id is
neither smaller than others nor has smaller ones, and has no labels; rows that repeat a doc_id are
no copies of each other; a null source is the part of the empty text; of several labels of a
doc_id any counts, a doc_id without labels counts as neither good nor toxic; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions.shared import written
from peakloom.llm.words import count_chars, let, words

MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, "#$%&*|"
FILTERS = "ABCDE"
#: Parts whose walks run together in a task.
PARTS = 256
#: What is counted of each cell.
KINDS = ("n", "good", "toxic")
_OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _mask(text: Column) -> Column:
    """Bits of the filters A to D that ``text`` fails."""
    of_words = let(words(text), lambda w: (F.size(w) < MIN_WORDS).cast("int") + 2 * (100 * F.size(F.array_distinct(w)) < DISTINCT_PERCENT * F.size(w)).cast("int"))
    capitals = (100 * count_chars(text, "A-Z").cast("long") > CAPITAL_PERCENT * F.length(text)).cast("int")
    return of_words + 4 * capitals + 8 * text.rlike(f"[{SYMBOLS}]").cast("int")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every row: bit i is set where it fails the i-th of FILTERS."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), _mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = written(rows, "audit-rows")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", "least")
    rows = rows.join(written(firsts, "audit-firsts"), "digest", "left")
    return rows.select("doc_id", "part", (F.col("mask") + 16 * F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int")).alias("mask"))


def cells(failing: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): how many rows of each mask a part has, how many of them are labelled good and toxic."""
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c)
    known = written(labels.groupBy("doc_id").agg(flag("quality"), flag("toxic")), "audit-labels")
    one = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    counts = failing.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), one("quality").alias("good"), one("toxic").alias("toxic"))
    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", *KINDS)).alias("cells"))


def transpositions(n: int) -> Iterator[int]:
    """Places i of the swaps (i, i + 1) that lead through all orders of ``n`` things (Steinhaus, Johnson and Trotter)."""
    if n < 2:
        return
    inner, down = transpositions(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        swap = next(inner, None)
        if swap is None:
            return
        yield swap + 1 if down else swap  # the last thing is in front, or behind
        down = not down


def walk(counts: np.ndarray, filters: Sequence[str]) -> tuple[list[str], dict[str, np.ndarray]]:
    """All orders, and kept, removed, redundant, good_lost, toxic_lost (part, order, step), unique_fails and shapley (part, filter). counts: kind, part, mask."""
    f, masks = len(filters), np.arange(1 << len(filters))
    order, swaps = list(range(f)), list(transpositions(f))
    names = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
    now = {name: np.zeros((counts.shape[1], f), np.int64) for name in names}
    every = {name: np.zeros((counts.shape[1], len(swaps) + 1, f), np.int64) for name in names}
    shapley, orders, last = np.zeros((counts.shape[1], f), np.int64), [], range(f)
    for k, swap in enumerate([None, *swaps]):
        if swap is not None:
            order[swap], order[swap + 1], last = order[swap + 1], order[swap], (swap, swap + 1)
        for step in last:
            own, before = 1 << order[step], sum(1 << x for x in order[:step])
            fails, open_ = (masks & own) != 0, (masks & before) == 0
            now["removed"][:, step], now["good_lost"][:, step], now["toxic_lost"][:, step] = counts[:, :, fails & open_].sum(2)
            now["redundant"][:, step] = counts[0][:, fails & ~open_].sum(1)
            now["kept"][:, step] = counts[0][:, ~fails & open_].sum(1)
        shapley[:, order] += now["removed"]
        orders.append("".join(filters[x] for x in order))
        for name in names:
            every[name][:, k] = now[name]
    return orders, every | {"unique_fails": counts[0][:, 1 << np.arange(f)], "shapley": shapley}


def audit(parts: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from the rows of ``cells``."""
    f = len(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PARTS):
                some = batch.slice(k, PARTS)
                names = some["part"].to_pylist()
                counts = np.zeros((len(KINDS), len(names), 1 << f), np.int64)
                for p, found in enumerate(some["cells"].to_pylist()):
                    for cell in found:
                        counts[:, p, cell["mask"]] += [cell[kind] for kind in KINDS]
                orders, every = walk(counts, filters)
                of = np.array([[filters.index(x) for x in order] for order in orders])
                columns = {"part": np.repeat(np.array(names, object), of.size), "filter_order": np.tile(np.repeat(np.array(orders, object), f), len(names)), "step": np.tile(np.arange(1, f + 1, dtype=np.int32), len(names) * len(orders))}
                columns |= {name: (every[name] if every[name].ndim == 3 else every[name][:, of]).ravel() for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
                yield pa.RecordBatch.from_pydict(columns)

    return parts.mapInArrow(run, _OUT)
