"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

Documents become pieces: only those longer than a sequence are cut, the first piece taking the
remainder, so that all others fill a sequence of their own. The rest are dealt at random into
blocks of bounded size. Every block is evolved on several islands, which are tasks of their own:
crossover injects whole well-filled bins of one parent into the other, dissolves the bins that
hold the same pieces, and best-fits the displaced ones. Between rounds each island's elite
migrates to the next island. The best island's packing of each block is the result.

Defined cases: null and empty texts are one end token; repeated rows are packed each; empty
tables give an empty result; very long texts, those of blanks alone too, become many pieces; the
tokenizer's added tokens (<|endoftext|>) are one id each where a text holds them; columns besides
doc_id and text are not read. The seed of every random choice is the block, island and round, so
lost tasks are recomputed alike.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.functions.shared import written
from peakloom.llm.arrow_words import slices
from peakloom.llm.byte_bpe import encoder, vocabulary

LENGTH, END_ID = 1024, 2
#: Pieces in a block in the mean, islands a block, rounds between migrations, individuals an island, children a round.
BLOCK, ISLANDS, ROUNDS, POPULATION, CHILDREN = 8192, 3, 3, 4, 12
#: Share of the parent's well-filled bins that a crossover injects, and how full such bins are.
INJECT, WELL_FILLED = 0.15, 0.99


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32 of all documents."""
    path = path or vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        for batch in slices(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                start, end = 0, len(ids) % length or length
                piece = 0
                while start < len(ids):
                    for column, value in zip(rows, (doc_id, piece, start, end - start, zlib.crc32(ids[start:end])), strict=True):
                        column.append(value)
                    start, end, piece = end, end + length, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the genetic algorithm ------------------------------------------------------------------


def best_fit(lengths: list[int], order: list[int], bins: np.ndarray, free: list[int], capacity: int) -> None:
    """Put the pieces of ``order`` each into the fullest bin with room for it. ``free``: room of the bins so far; both grow in place."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, room in enumerate(free):
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    for i in order:
        n = lengths[i]
        m = mask >> n
        if m:
            room = n + (m & -m).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins[i] = b
        room -= n
        free[b] = room
        if room:
            by_room[room].append(b)
            mask |= 1 << room


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Mean square of fill: higher for fewer and more uneven bins."""
    fill = np.bincount(bins, weights=lengths)
    return float(np.square(fill / capacity).sum() / len(fill))


def crossover(lengths: np.ndarray, mother: np.ndarray, father: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    fill = np.bincount(father, weights=lengths)
    good = np.flatnonzero(fill >= WELL_FILLED * capacity).tolist() or [int(fill.argmax())]
    injected = np.zeros(len(fill), bool)
    injected[rng.sample(good, max(1, int(INJECT * len(good))))] = True
    moved = injected[father]
    n_mother = int(mother.max()) + 1
    hit = np.zeros(n_mother, bool)
    hit[mother[moved]] = True
    loose = np.flatnonzero(np.bincount(mother, weights=lengths) < WELL_FILLED * capacity).tolist()
    hit[rng.sample(loose, len(loose) // 2)] = True
    kept = ~moved & ~hit[mother]
    renumber = np.cumsum(~hit) - 1
    child = np.full(len(mother), -1, np.int64)
    child[kept] = renumber[mother[kept]]
    base = int((~hit).sum())
    child[moved] = base + (np.cumsum(injected) - 1)[father[moved]]
    placed = child >= 0
    free = (capacity - np.bincount(child[placed], weights=lengths[placed], minlength=base + int(injected.sum())).astype(np.int64)).tolist()
    displaced = np.flatnonzero(~placed)
    order = displaced[np.lexsort((np.array([rng.random() for _ in range(len(displaced))]), -lengths[displaced]))]
    best_fit(lengths.tolist(), order.tolist(), child, free, capacity)
    return np.unique(child, return_inverse=True)[1]


def evolve(lengths: np.ndarray, guests: list[np.ndarray], capacity: int, seed: str) -> np.ndarray:
    """The best packing (bin of each piece) of one island's round, out of ``guests`` and fresh individuals."""
    rng = random.Random(seed)
    population = list(guests)
    values = lengths.tolist()
    while len(population) < POPULATION:
        noise = 0.0 if not population else 0.05 * len(population)
        order = sorted(range(len(values)), key=lambda i: -values[i] * (1 + noise * rng.random()))
        bins: np.ndarray = np.empty(len(values), np.int64)
        best_fit(values, order, bins, [], capacity)
        population.append(bins)
    ranked = sorted(((fitness(lengths, p, capacity), i, p) for i, p in enumerate(population)), key=lambda x: (-x[0], x[1]))
    least = math.ceil(lengths.sum() / capacity)
    for k in range(CHILDREN):
        if ranked[0][2].max() < least:  # no packing has fewer bins
            break
        a, b = rng.sample(range(len(ranked)), 2)
        child = crossover(lengths, ranked[min(a, b)][2], ranked[max(a, b)][2] if rng.random() < 0.5 else ranked[rng.randrange(len(ranked))][2], capacity, rng)
        worst = ranked[-1]
        if (f := fitness(lengths, child, capacity)) > worst[0]:
            ranked[-1] = (f, len(population) + k, child)
            ranked.sort(key=lambda x: (-x[0], x[1]))
    return ranked[0][2]


# --- its distribution -----------------------------------------------------------------------

_COLUMNS = (("doc_id", "<i8"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("ids_crc32", "<i8"))


def _gather(key: tuple, table: pa.Table) -> pa.Table:
    """A block as one row of packed columns. A null doc_id is a set bit of ``null``."""
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
    columns = {n: table[n].combine_chunks().fill_null(0).to_numpy().astype(k).tobytes() for n, k in _COLUMNS}
    null = np.packbits(np.asarray(table["doc_id"].combine_chunks().is_null())).tobytes()
    return pa.table({"block": [key[0].as_py()], **{n: [v] for n, v in columns.items()}, "null": [null]}, schema=_BLOCK)


_BLOCK = pa.schema([("block", pa.int64()), *[(n, pa.binary()) for n, _ in _COLUMNS], ("null", pa.binary())])


def _island_round(capacity: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["length"], "<i4").astype(np.int64)
                guests = [np.frombuffer(row[x], "<i4").astype(np.int64) for x in ("own", "guest") if row.get(x) is not None]
                best = evolve(lengths, guests, capacity, f"{row['block']}/{row['island']}/{turn}")
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "island": row["island"], "bins": int(best.max()) + 1, "fit": fitness(lengths, best, capacity), "elite": best.astype("<i4").tobytes()}])

    return run


_ELITE = "block long, island long, bins long, fit double, elite binary"


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            bins = np.frombuffer(row["elite"], "<i4").astype(np.int64)
            values = {n: np.frombuffer(row[n], k) for n, k in _COLUMNS}
            order = np.argsort(bins, kind="stable")
            ahead = np.concatenate([[0], np.cumsum(values["length"][order])[:-1]])
            first = np.r_[True, np.diff(bins[order]) > 0]
            offset = np.empty(len(bins), np.int64)
            offset[order] = ahead - ahead[np.flatnonzero(first)][np.cumsum(first) - 1]
            null = np.unpackbits(np.frombuffer(row["null"], np.uint8))[: len(bins)].astype(bool)
            arrays = [pa.array(values["doc_id"], mask=null), pa.array(values["piece"]), pa.array(values["start"]), pa.array(values["length"].astype(np.int64)), pa.array(values["ids_crc32"]), pa.array((row["block"] << 32) + bins), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, sequence_id, offset. Sequences of one full piece have negative ids."""
    cut = written(pieces(docs, path, length), "pieces")
    whole = cut.where(F.col("length") == length).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = cut.where(F.col("length") < length)
    n_blocks = max(1, -(-rest.count() // BLOCK))
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(n_blocks)))
    blocks = written(dealt.groupBy("block").applyInArrow(_gather, "block long, doc_id binary, piece binary, start binary, length binary, ids_crc32 binary, null binary"), "blocks")

    islands = blocks.select("block", "length", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)).cast("array<bigint>")).alias("island"))
    tasks = min(n_blocks * ISLANDS, 1 << 15)
    elites = written(islands.repartition(tasks, "block", "island").mapInArrow(_island_round(length, 0), _ELITE), "elites-0")
    for turn in range(1, ROUNDS):
        own = elites.select("block", "island", F.col("elite").alias("own"))
        guest = elites.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("guest"))
        visited = islands.join(own, ["block", "island"]).join(guest, ["block", "island"]).repartition(tasks, "block", "island")
        elites = written(visited.mapInArrow(_island_round(length, turn), _ELITE), f"elites-{turn}")
    best = elites.groupBy("block").agg(F.min_by("elite", F.struct(F.col("bins"), -F.col("fit"), F.col("island"))).alias("elite"))
    packed = blocks.join(best, "block").mapInArrow(_laid_out, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.unionByName(whole)
