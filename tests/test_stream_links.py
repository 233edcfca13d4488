"""The stream of links over slabs: equal to the batch clusters, early, with flat state."""

import random
from datetime import datetime, timezone

import pytest

from peakloom.operators import clustering
from peakloom.streaming.clusterer import link_stream, resolved

SCHEMA = "peak_id long, scan_ord long, mz double, at timestamp"


def points_of(n, scans, width, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), n)
    return [(i, s, round(rng.random() * width, 2), datetime.fromtimestamp(1_700_000_000 + s, timezone.utc)) for i, s in zip(ids, sorted(rng.randrange(scans) for _ in range(n)), strict=True)]


def run(spark, tmp_path, points, batches, **options):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    last = max(p[1] for p in points) + 1
    for k in range(batches):
        part = [p for p in points if p[1] * batches // last == k]
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = link_stream(stream, 0.15, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return spark.read.parquet(str(tmp_path / "out")), states


def batch(spark, points, min_size):
    df = spark.createDataFrame([p[:3] for p in points], "peak_id long, scan_ord long, mz double")
    return {r.peak_id: r.cluster_id for r in clustering.cluster(df, 0.15, 2, min_size).collect()}


@pytest.mark.parametrize("width", [None, 1.0])
def test_links_over_slabs_equal_the_batch(spark, tmp_path, width):
    points = points_of(1500, 60, 10.0, 3)
    links, _ = run(spark, tmp_path, points, 4, width=width)
    assert links.select("slab").distinct().count() == (1 if width is None else 10)
    assert links.where("scan_ord is not null").count() == len(points) == links.where("scan_ord is not null").select("peak_id").distinct().count()
    for min_size in (1, 5):
        assert {r.peak_id: r.cluster_id for r in resolved(links, min_size).collect()} == batch(spark, points, min_size)


def test_members_go_out_before_their_cluster_ends(spark, tmp_path):
    """One cluster over all scans: each batch's points are written with it, and half a stream gives half the cluster."""
    points = [(s, s, 5.0 + 0.01 * (s % 3), datetime.fromtimestamp(1_700_000_000 + s, timezone.utc)) for s in range(40)]
    half = [p for p in points if p[1] < 20]
    links, _ = run(spark, tmp_path / "half", half, 2, width=1.0)
    assert {r.cluster_id for r in resolved(links, 20).collect()} == {0}
    links, _ = run(spark, tmp_path / "all", points, 4, width=1.0)
    assert [tuple(r) for r in resolved(links, 40).select("cluster_id").distinct().collect()] == [(0,)]


def test_state_does_not_grow_with_the_stream(spark, tmp_path):
    _, short = run(spark, tmp_path / "short", points_of(1000, 50, 4.0, 1), 3, width=1.0)
    _, long = run(spark, tmp_path / "long", points_of(10_000, 500, 4.0, 1), 6, width=1.0)
    assert max(long) <= 2 * max(short) + 20


def test_slabs_must_be_wider_than_two_reaches(spark):
    df = spark.readStream.format("rate").load().selectExpr("value as peak_id", "value as scan_ord", "1.0d as mz", "timestamp as at")
    with pytest.raises(ValueError, match="wider"):
        link_stream(df, 0.5, width=1.0)


def test_a_batch_goes_out_in_slices(monkeypatch):
    """A batch of many slices: its links go out as they are found, colours of past scans are forgotten, and the links are those of one slice."""
    import pandas as pd

    from peakloom.streaming import clusterer

    class Held:
        def __init__(self):
            self.rows = []

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

    class Handle:
        def getListState(self, *_):  # noqa: N802
            return Held()

        def listTimers(self):  # noqa: N802
            return []

        def registerTimer(self, _):  # noqa: N802
            pass

    new = pd.DataFrame(points_of(3000, 100, 12.0, 6), columns=["peak_id", "scan_ord", "mz", "at"]).assign(own=True)
    outs, states, frames = [], [], []
    for size in (10**6, 150):
        monkeypatch.setattr(clusterer, "SLICE", size, raising=False)
        slab = clusterer._SlabLinks(0.15, 2, 3600)
        slab.init(Handle())
        frames.append(list(slab.handleInputRows((0,), iter([new]), None)))
        outs.append(pd.concat(frames[-1]).reset_index(drop=True))
        states.append(slab.recent.rows)
    assert len(frames[1]) == 20 and max(map(len, frames[1])) < 600
    assert outs[0].equals(outs[1]) and states[0] == states[1]


def test_a_crowded_batch_follows_its_points():
    """Scans of 4,000 points within reach of one another, which are 32 million hits a scan: the batch takes seconds, and old colours that meet are told once."""
    import time

    import numpy as np

    from peakloom.streaming.clusterer import colours

    n, start = 4000, time.monotonic()
    scan, mz = np.repeat(np.arange(30), n), np.tile(np.linspace(5.0, 5.1, n), 30)
    ids = np.random.default_rng(2).permutation(len(scan)) + 10
    before = np.where(np.arange(2 * n) % 2, 7, 3)
    colour, old, became = colours(scan, mz, ids, before, np.arange(len(ids)) >= 2 * n, 0.15, 2)
    assert (colour == 3).all() and old.tolist() == [3, 7] and became.tolist() == [3, 3]
    assert time.monotonic() - start < 20
    apart, _, _ = colours(np.array([0, 1, 2, 2]), np.array([1.0, 9.0, 1.1, 1.2]), np.array([4, 8, 6, 2]), np.array([], np.int64), np.array([False, True, True, False]), 0.15, 2)
    assert apart.tolist() == [4, 8, 4, 2]
