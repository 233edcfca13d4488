"""Connected components of an edge list, by alternating large-star and small-star rounds.

Edges are dealt to partitions of bounded size by their number, and each is contracted to stars first,
so that only links between partitions are left to the rounds. Every round rewrites the edges as stars around smaller nodes
(published as the two-phase alternating algorithm); it ends when a round changes nothing. Only
edges move, pre-aggregated by node, and every round's edges are a table in the shared folder,
whose size and checksum are taken while it is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from peakloom.functions.shared import written

#: Edges (16 bytes each) of a partition in the mean, and those that are contracted at once; bounds memory, not results.
CHUNK = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some edges but the least of its component, with that least node."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := root[root], root):
            root = up
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars; more than CHUNK / 2 of them may be of several contractions."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch["u"].to_numpy(), batch["v"].to_numpy()))
        size += batch.num_rows
        if size >= CHUNK:
            held = [stars(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))]
            size = len(held[0][0])
            if size > CHUNK // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["u", "v"])
                held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))], ["u", "v"])


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """Rows (u, v) with m, the least of u and its v's."""
    least = pairs.groupBy(F.col("u").alias("w")).agg(F.min(F.least("u", "v")).alias("m"))
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _least_neighbour(down)
    return starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(starred.select("u", F.col("m").alias("v")))


def _recorded(edges: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """``edges`` as a written table, with their number and checksum."""
    seen = Observation()
    sums = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    table = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), sums.alias("h")), name)
    return table, seen.get


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of ``edges`` (integers) and the least node that it can reach.

    Self-loops keep a node in the result; null ends are dropped; no edges give no rows.
    """
    given = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    links, state = _recorded(given.where("u <> v"), "links")
    parts = -(-state["n"] // CHUNK)
    now, state = _recorded(links.coalesce(max(1, parts)).mapInArrow(_contract, "u long, v long"), "stars")
    whole = parts <= 1 and state["n"] <= CHUNK // 2  # all in one contraction
    while state["n"] and not whole:
        seen = state["n"], state["h"]
        now, state = _recorded(_small_star(_large_star(now).distinct()).where("u <> v").distinct(), "stars")
        whole = (state["n"], state["h"]) == seen
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    loops = given.where("u = v").select(F.col("u").alias("node")).distinct()
    labelled = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    return labelled.union(loops.join(labelled.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
