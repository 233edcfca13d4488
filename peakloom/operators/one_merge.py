"""The one-pass rule of clustering with a limit on merges, in parallel over slabs of mz.

Points come in the order (scan, mz, peak_id). A point takes the colour of its first hit, then merges up to
``max_merges`` other colours into it; which of its hits have other colours depends on all merges before,
also on those that happened elsewhere. So a slab of mz cannot be worked on alone, but all that it has
to know of the others is when points near its two ends became one colour out there.

Slabs go through their points in order at the same time, each with the points of its neighbours within
reach and with what the neighbours told it: events (time, point, point), each the moment at which two
points near the cut were joined on the teller's side. What a slab tells one neighbour comes from its own
merges and from what the other neighbour told it, never from that neighbour itself, so a wrong claim
cannot keep itself alive. Rounds are repeated, for slabs that were told something new, until nothing
changes. A decision depends on earlier ones alone, so what is left then is the sequential result.

Points of one scan and mz have the same hits, so they come as one row, ask once, and, if there is a
hit, are one colour from then on: away from the cuts the least of them stands for all. The merges that each of
them may make go on where the one before left off. No news falls between them, as they are of one slab.

A task streams its slab in order; it holds the points of the last scans, those near the cuts, and colours.
Rounds that are needed grow with how far news travel (in the mean a few; a chain across all slabs
needs as many as there are slabs). Cuts are moved into gaps of mz where there are some.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions.shared import written
from peakloom.operators.components import connected_components

#: Points a slab in the mean, those of one scan and mz counted once.
SLAB_POINTS = 100_000
_EVENTS = "slab int, kind int, scan_ord long, mz double, peak_id long, a long, b long"
_ROWS = f"{_EVENTS}, more array<bigint>"
_SCHEMA = pa.schema([("slab", pa.int32()), ("kind", pa.int32()), ("scan_ord", pa.int64()), ("mz", pa.float64()), ("peak_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
#: Rows of a slab: its own points, those of the slab below and above, and what they tell; links go out, or (ADOPT) the first link of points of one scan and mz.
OWN, BELOW, ABOVE, FROM_BELOW, FROM_ABOVE, LINK, ADOPT = range(7)


class Colours:
    """Disjoint sets of points. ``shared`` (if any) tells the points near a cut; joins of two of them are told to ``tell``."""

    def __init__(self, shared: set[int] | None = None, tell: Callable[[int, int], None] | None = None) -> None:
        self.of: dict[int, int] = {}
        self.up: dict[int, int] = {}
        self.shared, self.tell, self.known = shared, tell, {}

    def add(self, point: int) -> None:
        self.of[point] = self.up[point] = point
        if self.shared is not None and point in self.shared:
            self.known[point] = point

    def find(self, point: int) -> int:
        """The colour of ``point``; its own if it is not held."""
        x = self.of[point]
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def adopt(self, point: int, other: int) -> None:
        """A new ``point`` of the colour of ``other``."""
        x = self.of[point] = self.find(other)
        if self.shared is not None and point in self.shared:
            if x in self.known:
                self.tell(point, self.known[x])
            else:
                self.known[x] = point

    def join(self, a: int, b: int) -> bool:
        x, y = self.find(a), self.find(b)
        if x == y:
            return False
        self.up[y] = x
        if self.shared is not None and y in self.known:
            if x in self.known:
                self.tell(self.known[x], self.known.pop(y))
            else:
                self.known[x] = self.known.pop(y)
        return True

    def forget(self, point: int) -> None:
        self.of.pop(point, None)


class Slab:
    """One slab's points and news in order; ``out`` gathers rows of links and of what it tells."""

    def __init__(self, slab: int, mz_dist: float, n_prev: int, max_merges: int | None, low: float, high: float) -> None:
        self.slab, self.mz_dist, self.n_prev, self.max_merges, self.low, self.high = slab, mz_dist, n_prev, max_merges, low, high
        self.out: list[tuple] = []
        self.time: tuple[int, float, int] = (0, 0.0, 0)
        self.near: tuple[set[int], set[int]] = (set(), set())
        tell = lambda to, kind: lambda a, b: self.out.append((to, kind, *self.time, a, b))
        # what is told below leaves out what came from below, and so above
        self.all, self.for_below, self.for_above = Colours(), Colours(self.near[0], tell(slab - 1, FROM_ABOVE)), Colours(self.near[1], tell(slab + 1, FROM_BELOW))
        self.sets = (self.all, self.for_below, self.for_above)
        # of each scan: mz, points, and for each place one further up its run of one colour (itself at the end that is known)
        self.scans: dict[int, tuple[list[float], list[int], list[int]]] = {}

    def take(self, kind: int, scan: int, mz: float, point: int, a: int, b: int, more: Sequence[int] = ()) -> None:
        self.time = (scan, mz, point)
        if kind in (FROM_BELOW, FROM_ABOVE):
            self.all.join(a, b)
            (self.for_above if kind == FROM_BELOW else self.for_below).join(a, b)
            return
        points = [point, *more]
        below = kind == BELOW or (kind == OWN and mz - self.low <= self.mz_dist)
        above = kind == ABOVE or (kind == OWN and self.high - mz <= self.mz_dist)
        if below:
            self.near[0].update(points)
        if above:
            self.near[1].update(points)
        if scan not in self.scans:
            self._forget(scan - self.n_prev)
            self.scans[scan] = ([], [], [])
        if kind == OWN:
            points = self._own(scan, mz, points, below or above)
        else:
            self._add(points)
        values, ids, runs = self.scans[scan]  # in order, so that a scan has all its points when it is asked
        values += [mz] * len(points)
        ids += points
        runs += range(len(runs), len(ids))

    def _hits(self, scan: int, mz: float) -> Iterator[int]:
        """The first hit of each run of one colour. Colours only ever join, so a run that was found is skipped from then on."""
        for k in range(1, self.n_prev + 1):
            values, points, runs = self.scans.get(scan - k, ((), (), ()))
            j = bisect.bisect_left(values, mz - self.mz_dist)
            while j and values[j - 1] - mz >= -self.mz_dist:
                j -= 1
            while j < len(values) and values[j] - mz < -self.mz_dist:
                j += 1
            while j < len(values) and values[j] - mz <= self.mz_dist:
                yield points[j]
                colour, end = self.all.find(points[j]), self._end(runs, j)
                while end + 1 < len(values) and values[end + 1] - mz <= self.mz_dist and self.all.find(points[end + 1]) == colour:
                    runs[end] = end + 1
                    end = self._end(runs, end + 1)
                j = end + 1

    @staticmethod
    def _end(runs: list[int], j: int) -> int:
        while runs[j] != j:
            runs[j] = j = runs[runs[j]]
        return j

    def _add(self, points: list[int]) -> None:
        for point in points:
            for s in self.sets:
                s.add(point)

    def _own(self, scan: int, mz: float, points: list[int], near: bool) -> list[int]:
        """Links of points of one scan and mz, in order; those of them that later points hit."""
        hits = self._hits(scan, mz)
        first, left = next(hits, None), True
        if first is None:
            self._add(points)
            return points
        one = not near and len(points) > 1
        for point in points[:1] if one and self.max_merges is None else points:
            self.time = (scan, mz, point)
            stands = points[0] if one else point
            if point == stands:
                for s in self.sets:
                    s.adopt(point, first)
                self.out.append((self.slab, ADOPT if one else LINK, *self.time, point, first))
            left = left and self._merge(stands, hits)
            if one and not left:
                break
        return points[:1] if one else points

    def _merge(self, point: int, hits: Iterator[int]) -> bool:
        """Merge the colours of ``hits`` into that of ``point``, up to the limit; false if there are no more."""
        merges = 0
        for hit in hits:
            if self.all.join(point, hit):
                self.for_below.join(point, hit)
                self.for_above.join(point, hit)
                self.out.append((self.slab, LINK, *self.time, point, hit))
                merges += 1
                if self.max_merges is not None and merges >= self.max_merges:
                    return True
        return False

    def _forget(self, before: int) -> None:
        """Points of scans that no later point reaches, but for those near the cuts, of which news may come."""
        for scan in [s for s in self.scans if s < before]:
            for point in self.scans.pop(scan)[1]:
                if point not in self.near[0] and point not in self.near[1]:
                    for s in self.sets:
                        s.forget(point)


def cuts(points: DataFrame, mz_dist: float, slab_points: int = SLAB_POINTS) -> list[float]:
    """Where slabs of about ``slab_points`` points end, in the middle of gaps where there are some nearby; slabs are wider than four reaches."""
    n = points.count()
    k = -(-n // slab_points)
    if k < 2:
        return []
    found = points.agg(F.percentile_approx("mz", F.lit([i / k for i in range(1, k)]), F.lit(10_000)).alias("q"), F.min("mz").alias("lo"), F.max("mz").alias("hi")).first()
    wide, at = [], found.lo
    for q in found.q:
        if q - at > 4 * mz_dist and found.hi - q > 4 * mz_dist:
            wide.append(q)
            at = q
    if not wide:
        return []
    ends = [found.lo, *wide, found.hi]
    windows = [(i, q - (q - ends[i]) / 4, q + (ends[i + 2] - q) / 4) for i, q in enumerate(wide)]
    spans = points.sparkSession.createDataFrame(windows, "i int, lo double, hi double")
    cells = points.join(F.broadcast(spans), F.col("mz").between(F.col("lo"), F.col("hi"))).select("i", F.floor(F.col("mz") / mz_dist).alias("c"))
    ends_too = [spans.select("i", f(F.col(c) / mz_dist).alias("c")) for f, c in ((F.floor, "lo"), (F.ceil, "hi"))]
    cells = cells.union(ends_too[0]).union(ends_too[1]).distinct()
    lag = F.lag("c").over(Window.partitionBy("i").orderBy("c"))
    gaps = cells.withColumn("before", lag).where(F.col("c") - F.col("before") > 2).groupBy("i").agg(F.max(F.struct((F.col("c") - F.col("before")).alias("w"), "c")).alias("g"))
    moved = {r.i: (r.g.c - (r.g.w - 1) / 2) * mz_dist for r in gaps.collect()}  # a row a cut
    return [moved.get(i, q) for i, q in enumerate(wide)]


def _grouped(points: DataFrame) -> DataFrame:
    """A row for each scan_ord and mz of ``points``: the least peak_id, and more of them in order."""
    plain = points.select(F.col("scan_ord").cast("long").alias("scan_ord"), F.col("mz").cast("double").alias("mz"), F.col("peak_id").cast("long").alias("peak_id"))
    ids = plain.groupBy("scan_ord", "mz").agg(F.sort_array(F.collect_list("peak_id")).alias("ids"))
    return ids.select("scan_ord", "mz", F.col("ids")[0].alias("peak_id"), F.slice("ids", F.lit(2), F.size("ids")).alias("more"))


def _dealt(groups: DataFrame, at: list[float], mz_dist: float) -> DataFrame:
    """Rows of slabs: each row of points in its own, and in the neighbour's if that can reach it."""
    reach = mz_dist * (1 + 1e-9)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.array(at)
        for batch in batches:
            mz = batch["mz"].to_numpy()
            slab = np.searchsorted(ends, mz, "right").astype(np.int32)
            low, high = np.append(-np.inf, ends)[slab], np.append(ends, np.inf)[slab]
            up, down = np.flatnonzero(high - mz <= reach), np.flatnonzero(mz - low <= reach)
            rows = np.concatenate([np.arange(len(mz)), up, down])
            to = np.concatenate([slab, slab[up] + 1, slab[down] - 1]).astype(np.int32)
            kind = np.concatenate([np.full(len(mz), OWN), np.full(len(up), BELOW), np.full(len(down), ABOVE)]).astype(np.int32)
            took = batch.take(pa.array(rows))
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(kind), took["scan_ord"], took["mz"], took["peak_id"], none, none, took["more"]], [*_SCHEMA.names, "more"])

    return groups.mapInArrow(deal, _ROWS)


def _round(rows: DataFrame, at: list[float], mz_dist: float, n_prev: int, max_merges: int | None) -> DataFrame:
    """What slabs link and tell, out of their points and what they were told."""
    reach = mz_dist * (1 + 1e-9)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, own = [-np.inf, *at, np.inf], None
        for batch in batches:
            for slab, kind, scan, mz, point, a, b, more in zip(*(batch[c].to_pylist() for c in (*_SCHEMA.names, "more")), strict=True):
                if own is None or own.slab != slab:
                    if own is not None:
                        yield _batch(own.out)
                    own = Slab(slab, mz_dist, n_prev, max_merges, ends[slab] + mz_dist - reach, ends[slab + 1] - mz_dist + reach)
                own.take(kind, scan, mz, point, a, b, more or ())
                if len(own.out) >= 50_000:
                    yield _batch(own.out)
                    own.out.clear()
        if own is not None:
            yield _batch(own.out)

    ordered = rows.repartition("slab").sortWithinPartitions("slab", "scan_ord", "mz", "peak_id", "kind")
    return ordered.mapInArrow(go, _EVENTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _from(out: DataFrame) -> DataFrame:
    """``out`` with the slab that each row came from."""
    return out.withColumn("by", F.when(F.col("kind") == FROM_ABOVE, F.col("slab") + 1).when(F.col("kind") == FROM_BELOW, F.col("slab") - 1).otherwise(F.col("slab")))


def _found(points: DataFrame, mz_dist: float, n_prev: int, max_merges: int | None, slab_points: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows of links and first links, members (a: the point that stands for them, peak_id, b: its first link) of points of one scan and mz, and the number of rounds."""
    groups = written(_grouped(points), "points-of-a-place")
    at = cuts(groups, mz_dist, slab_points)
    rows = written(_dealt(groups, at, mz_dist), "slabs")
    events = [c for c in rows.columns if c != "more"]
    out = written(_from(_round(rows, at, mz_dist, n_prev, max_merges)), "slab-round")
    before, rounds = None, 1
    while at:
        news = out.where(F.col("kind") < LINK).select(*events)
        differ = news if before is None else news.union(before).groupBy(*events).agg(F.count(F.lit(1)).alias("n")).where("n = 1")
        changed = written(differ.select("slab").distinct(), "slabs-told")
        if changed.isEmpty():
            break
        told = rows.union(news.withColumn("more", F.lit(None).cast("array<bigint>")))
        again = _from(_round(told.join(F.broadcast(changed), "slab", "left_semi"), at, mz_dist, n_prev, max_merges))
        kept = out.join(F.broadcast(changed.select(F.col("slab").alias("by"))), "by", "left_anti")
        out, before, rounds = written(kept.unionByName(again), "slab-round"), news, rounds + 1
    made = out.where(F.col("kind") >= LINK)
    members = groups.where(F.size("more") > 0).join(made.where(F.col("kind") == ADOPT).select(F.col("a").alias("peak_id"), "b"), "peak_id")
    return made, members.select(F.col("peak_id").alias("a"), F.explode("more").alias("peak_id"), "b"), rounds


def links(points: DataFrame, mz_dist: float, n_prev: int, max_merges: int | None, slab_points: int = SLAB_POINTS) -> tuple[DataFrame, int]:
    """(a, b): the links that the rule makes between points (peak_id, scan_ord, mz), and the number of rounds that it took."""
    made, members, rounds = _found(points, mz_dist, n_prev, max_merges, slab_points)
    return made.select(F.col("peak_id").alias("a"), "b").union(members.select(F.col("peak_id").alias("a"), "b")), rounds


def labels(points: DataFrame, mz_dist: float, n_prev: int, max_merges: int | None, slab_points: int = SLAB_POINTS) -> DataFrame:
    """(peak_id, cluster_id) of all points with a link."""
    made, members, _ = _found(points, mz_dist, n_prev, max_merges, slab_points)
    parts = written(connected_components(made.select("a", "b")).select(F.col("node").alias("peak_id"), F.col("component").alias("cluster_id")), "labels")
    rest = members.select("a", F.col("peak_id").alias("p")).join(parts, F.col("a") == F.col("peak_id")).select(F.col("p").alias("peak_id"), "cluster_id")
    return parts.union(rest)
