"""Clustering of an unbounded stream of peaks in retention-time order; the state holds what is still open."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from peakloom.functions.shared import written
from peakloom.operators import bands
from peakloom.operators.clustering import OnePass
from peakloom.operators.components import connected_components, stars

OUTPUT = "cluster_id bigint, peak_id bigint, scan_ord bigint, mz double"


class OpenClusters:
    """Clusters that later points can still reach, with their points."""

    def __init__(self, mz_dist: float, n_prev: int, max_merges: int | None) -> None:
        self.rule = OnePass(mz_dist, n_prev, max_merges)
        self.members: dict[int, list[tuple[int, int, float]]] = {}
        self.last: dict[int, int] = {}
        self.now = -1

    def add(self, peak_id: int, scan_ord: int, mz: float) -> None:
        self.now = max(self.now, scan_ord)
        mine, merged = self.rule.add(peak_id, scan_ord, mz)
        for other in merged:
            self.members[mine] += self.members.pop(other)
            del self.last[other]
        self.members.setdefault(mine, []).append((peak_id, scan_ord, mz))
        self.last[mine] = scan_ord

    def close(self, everything: bool = False) -> Iterator[list[tuple[int, int, float]]]:
        """Clusters that no point of a later scan can reach, taken out of the state."""
        reach = self.now + 1 if everything else self.now - self.rule.n_prev
        self.rule.forget(reach)
        for c in [c for c, seen in self.last.items() if seen < reach]:
            points = self.members.pop(c)
            del self.last[c]
            for p, _, _ in points:
                del self.rule.root[p]
            yield points


def cluster_stream(points: DataFrame, mz_dist: float, n_prev: int = 2, min_size: int = 20, max_merges: int | None = None, slab: str = "slab", watermark: str = "0 seconds") -> DataFrame:
    """Closed clusters of a stream of points (peak_id, scan_ord, mz, at timestamp, ``slab``).

    No link may cross slabs: take one slab for dense data, or ranges of mz with gaps over ``mz_dist``
    between them. Clusters close when their scans have passed, and all of them when the watermark
    passes the last point of their slab. The size limit holds for whole clusters. The state of a slab
    is its last scans and the points of its open clusters, so it grows with what stays open.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clusters = pickle.loads(state.get[0]) if state.exists else OpenClusters(mz_dist, n_prev, max_merges)
        if state.hasTimedOut:
            done = list(clusters.close(everything=True))
            state.remove()
        else:
            rows = pd.concat(frames).sort_values(["scan_ord", "mz", "peak_id"])
            for peak_id, scan_ord, mz in rows[["peak_id", "scan_ord", "mz"]].itertuples(index=False, name=None):
                clusters.add(int(peak_id), int(scan_ord), float(mz))
            done = list(clusters.close())
            state.update((pickle.dumps(clusters),))
            state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        out = [(min(p for p, _, _ in points), *point) for points in done if len(points) >= min_size for point in points]
        yield pd.DataFrame(out, columns=["cluster_id", "peak_id", "scan_ord", "mz"])

    keyed = points.withWatermark("at", watermark).groupBy(slab)
    return keyed.applyInPandasWithState(run, OUTPUT, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


LINKS = "slab bigint, peak_id bigint, colour bigint, scan_ord bigint, mz double"
_RECENT = "scan_ord bigint, mz double, peak_id bigint, colour bigint, own boolean"
#: Rows of a slab that go out at once.
SLICE = 1 << 14
#: Seconds of event time after which a slab without new points is forgotten.
IDLE_SECONDS = 3600


def colours(scan: np.ndarray, mz: np.ndarray, ids: np.ndarray, before: np.ndarray, asks: np.ndarray, mz_dist: float, n_prev: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Colours of points after those that ``asks`` names have met all points within reach of the ``n_prev`` scans before; and old colours with the ones that they became.

    ``before`` are the colours of the last points (the first ones). What a point hits at a scan is a range, so
    the work follows the points and not their hits (see ``bands``). A colour is the least old one, or the least id.
    """
    points, n = bands.Ordered(scan - scan.min(), mz, mz_dist), len(ids)
    links = []
    for k in range(1, n_prev + 1):
        at = np.flatnonzero(asks[points.order] & (points.place >= k))
        lo, hi = points.ranges(points.place[at] - k, at)
        hit = hi > lo
        links.append((at[hit], lo[hit], hi[hit]))
    part = np.empty(n, np.int64)
    part[points.order] = bands.joined(n, links)
    old, of = np.unique(before, return_inverse=True)
    root = np.arange(n + len(old))
    far, least = stars(part[: len(before)], of + n)
    root[far] = least
    part, were = root[part], root[n:]
    most = np.iinfo(np.int64).max
    name, known = np.full(len(root), most), np.full(len(root), most)
    np.minimum.at(name, part, ids)
    np.minimum.at(known, were, old)
    name = np.where(known < most, known, name)
    return name[part], old, name[were]


class _SlabLinks(StatefulProcessor):
    """Links of a slab's points with those of its last scans; the state is those scans' points with their colours."""

    def __init__(self, mz_dist: float, n_prev: int, idle: float) -> None:
        self.mz_dist, self.n_prev, self.idle = mz_dist, n_prev, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.recent = handle, handle.getListState("recent", _RECENT)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        names = ["scan_ord", "mz", "peak_id", "own"]
        held = [tuple(r) for r in self.recent.get()]
        new = pd.concat(rows).sort_values(["scan_ord", "mz", "peak_id"])
        newest, last, late = int(new["at"].max().timestamp() * 1000), max(int(new["scan_ord"].max()), 0), len(held)
        types = {"scan_ord": "int64", "mz": "float64", "peak_id": "int64", "own": "bool"}
        frames = [pd.DataFrame([(s, m, p, o) for s, m, p, _, o in held], columns=names).astype(types), new[names].astype(types)]
        scan, mz, ids, own = (np.concatenate([f[c].to_numpy() for f in frames]) for c in names)
        fresh = np.arange(len(ids)) >= late
        colour, old, became = colours(scan, mz, ids, np.array([r[3] for r in held], np.int64), own & fresh, self.mz_dist, self.n_prev)
        # another slab's point has a colour of its own until a point of this one meets it
        met, changed, mine = fresh & ~own & (colour != ids), old != became, fresh & own
        merges = pd.DataFrame({"peak_id": np.concatenate([ids[met], old[changed]]), "colour": np.concatenate([colour[met], became[changed]])})
        out = pd.concat([pd.DataFrame({"peak_id": ids[mine], "colour": colour[mine], "scan_ord": pd.array(scan[mine], "Int64"), "mz": mz[mine]}), merges.assign(scan_ord=pd.array([pd.NA] * len(merges), "Int64"), mz=np.nan)])
        for at in range(0, len(out), SLICE):
            part = out[at : at + SLICE]
            yield pd.DataFrame({"slab": np.full(len(part), key[0], np.int64)} | {c: part[c].array for c in ("peak_id", "colour", "scan_ord", "mz")})
        kept = np.flatnonzero(scan >= last - self.n_prev)
        kept = kept[np.lexsort((ids[kept], mz[kept], scan[kept]))]
        self.recent.put(list(zip(*(c[kept].tolist() for c in (scan, mz, ids, colour, own)), strict=True)))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(newest + int(self.idle * 1000))

    def handleExpiredTimer(self, key: tuple, timers: object, expired: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def link_stream(points: DataFrame, mz_dist: float, n_prev: int = 2, width: float | None = None, watermark: str = "0 seconds", idle: float = IDLE_SECONDS) -> DataFrame:
    """Members and merges of a stream of points (peak_id, scan_ord, mz, at timestamp) in scan order, as soon as they are known.

    Slabs of mz (``width``; one slab without it) keep the points of their last ``n_prev`` scans and the
    neighbours' points within reach, so state follows the density of scans, not the length of the stream or of
    clusters. A row with scan_ord is a point with its slab's colour at that moment; one without says that
    the colour ``peak_id`` (or another slab's point of that id) is the same cluster as ``colour``. Rows are
    edges between peak_ids: ``resolved`` makes clusters of what has come so far. A slab without points
    for ``idle`` seconds is forgotten by a timer; points that come behind later scans link with nothing.
    Needs the state store on RocksDB, which this sets for the session.
    """
    if width is not None and width <= 2 * mz_dist:
        raise ValueError("slabs must be wider than two reaches")
    points.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    of = lambda mz: F.floor(mz / width).cast("bigint") if width else F.lit(0).cast("bigint")
    reach = mz_dist * (1 + 1e-9)
    slab = of(F.col("mz"))
    near = F.array_distinct(F.array(slab, of(F.col("mz") - reach), of(F.col("mz") + reach)))
    dealt = points.select("peak_id", F.col("scan_ord").cast("bigint").alias("scan_ord"), "mz", "at", slab.alias("home"), F.explode(near).alias("slab"))
    keyed = dealt.withColumn("own", F.col("slab") == F.col("home")).withWatermark("at", watermark).groupBy("slab")
    return keyed.transformWithStateInPandas(_SlabLinks(mz_dist, n_prev, idle), LINKS, "append", "eventtime")


def resolved(links: DataFrame, min_size: int = 20) -> DataFrame:
    """Clusters (cluster_id, peak_id, scan_ord, mz) of ``min_size`` points, of the rows of ``link_stream`` that have been written."""
    links = written(links, "stream-links")
    # a point's id is a node only where it names a colour or is met by another slab; all others hang on their colour
    apart, merges = links.where("peak_id <> colour"), links.where("scan_ord is null").select("peak_id", "colour")
    names = written(apart.select("colour").union(merges.select("peak_id")).distinct(), "stream-names")
    edges = merges.union(apart.where("scan_ord is not null").select("peak_id", "colour").join(names.select(F.col("colour").alias("peak_id")), "peak_id", "left_semi"))
    labels = connected_components(edges, "peak_id", "colour").withColumnRenamed("node", "colour")
    members = links.where("scan_ord is not null").join(labels, "colour", "left")
    members = written(members.select(F.coalesce("component", "colour").alias("part"), "peak_id", "scan_ord", "mz"), "stream-members")
    large = members.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("peak_id").alias("cluster_id")).where(F.col("n") >= min_size).select("part", "cluster_id")
    return members.join(written(large, "stream-sizes"), "part").select("cluster_id", "peak_id", "scan_ord", "mz")
