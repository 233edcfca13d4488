"""The one-pass rule over slabs against a loop over all points."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import clustering, one_merge
from peakloom.operators.clustering import sequential_labels


def in_order(points):
    return sorted(points, key=lambda p: (p[1], p[2], p[0]))


def by_loop(points, mz_dist, n_prev, max_merges):
    points = in_order(points)
    colours, least = sequential_labels([p[1] for p in points], [p[2] for p in points], mz_dist, n_prev, max_merges), {}
    for c, p in zip(colours, points, strict=True):
        least[c] = min(p[0], least.get(c, p[0]))
    return {p[0]: least[c] for c, p in zip(colours, points, strict=True)}


def table(spark, points):
    return spark.createDataFrame(points, "peak_id long, scan_ord int, mz double").repartition(3)


@pytest.mark.parametrize(("seed", "max_merges", "n_prev", "scans"), [(1, 1, 2, 25), (2, 1, 1, 60), (3, 2, 3, 25), (4, None, 2, 40)])
def test_slabs_give_the_sequential_result(spark, seed, max_merges, n_prev, scans):
    rng = random.Random(seed)
    ids = rng.sample(range(100_000), 900)
    points = [(i, rng.randrange(scans), round(rng.random() * 12, 2)) for i in ids]
    df = table(spark, points)
    assert len(one_merge.cuts(df, 0.2, 120)) >= 5
    got = {r.peak_id: r.cluster_id for r in clustering.cluster(df, 0.2, n_prev, 1, max_merges, 120).collect()}
    assert got == by_loop(points, 0.2, n_prev, max_merges)


def test_cuts_lie_in_gaps_and_far_apart(spark):
    points = [(i, i % 7, 1 + (i % 10) + 0.01 * (i % 13)) for i in range(1000)]
    at = one_merge.cuts(table(spark, points), 0.05, 200)
    assert len(at) == 4 and all(min(abs(p[2] - c) for p in points) > 0.05 for c in at)
    assert one_merge.cuts(table(spark, points), 4.0, 200) == [] and one_merge.cuts(table(spark, []), 0.05, 10) == []
    links, rounds = one_merge.links(table(spark, points), 0.05, 2, 1, 200)
    assert rounds == 1 and links.count() > 0


def test_news_over_many_slabs(spark):
    """Two rails along mz that meet only at the far end, and rungs whose merges depend on whether they have met."""
    points, k = [], 0
    for step in range(160):  # both go up one cell a scan
        for rail in (0.0, 0.35):
            points.append((k, step, step * 0.1 + rail))
            k += 1
    rng = random.Random(5)
    points += [(k + i, rng.randrange(300), round(rng.random() * 16, 3)) for i in range(900)]
    for max_merges in (1, 2):
        df = table(spark, points)
        links, rounds = one_merge.links(df, 0.15, 2, max_merges, 100)
        assert rounds > 2
        got = {r.peak_id: r.cluster_id for r in clustering.cluster(df, 0.15, 2, 1, max_merges, 100).collect()}
        assert got == by_loop(points, 0.15, 2, max_merges)


def test_a_slab_forgets_what_nothing_reaches():
    slab = one_merge.Slab(1, 0.1, 2, 1, 10.0, 20.0)
    rng = np.random.default_rng(1)
    for scan in range(400):
        for j, mz in enumerate(np.sort(rng.uniform(10.2, 19.8, 20)).tolist()):
            slab.take(one_merge.OWN, scan, mz, scan * 100 + j, None, None)
    assert len(slab.all.of) <= 60 and len(slab.scans) <= 4


def test_empty_table_and_single_points(spark):
    assert clustering.cluster(table(spark, []), 0.1, 2, 1, 1).count() == 0
    got = clustering.cluster(table(spark, [(5, 1, 2.0), (6, 9, 2.0)]).withColumn("intensity", F.lit(1.0)), 0.1, 2, 1, 1)
    assert {r.peak_id: r.cluster_id for r in got.collect()} == {5: 5, 6: 6}


def test_runs_of_one_colour_are_asked_once(monkeypatch):
    """300 points a scan, all within reach of one another: three finds a point and not one for each of 600 hits."""
    asked = []
    find = one_merge.Colours.find
    monkeypatch.setattr(one_merge.Colours, "find", lambda self, p: asked.append(p) or find(self, p))
    slab = one_merge.Slab(0, 1.0, 2, 1, -np.inf, np.inf)
    points = [(s * 300 + i, s, 5 + i / 1000) for s in range(12) for i in range(300)]
    for point, scan, mz in points:
        slab.take(one_merge.OWN, scan, mz, point, None, None)
    assert len(asked) < 60 * len(points)
    colours = dict(zip((p[0] for p in points), sequential_labels([p[1] for p in points], [p[2] for p in points], 1.0, 2, 1), strict=True))
    late = [p[0] for p in points if p[1] > 9]
    assert len({slab.all.find(p) for p in late}) == len({colours[p] for p in late})


def copied(seed, copies, scans=40, n=250):
    """Points of which most have copies of the same scan and mz."""
    rng = random.Random(seed)
    places = [(rng.randrange(scans), round(rng.random() * 12, 2)) for _ in range(n)]
    rows = [p for p in places for _ in range(rng.choice([1, copies, copies + 3]))]
    return [(i, *p) for i, p in zip(rng.sample(range(100_000), len(rows)), rows, strict=True)]


@pytest.mark.parametrize(("seed", "max_merges", "n_prev", "slab"), [(1, 1, 2, 30), (2, 2, 1, 60), (3, 1, 3, 1000), (4, None, 2, 40), (5, 1, 2, 30)])
def test_copies_give_the_sequential_result(spark, seed, max_merges, n_prev, slab):
    points = copied(seed, 4)
    got = {r.peak_id: r.cluster_id for r in clustering.cluster(table(spark, points), 0.3, n_prev, 1, max_merges, slab).collect()}
    assert got == by_loop(points, 0.3, n_prev, max_merges)


def test_copies_ask_once(spark, monkeypatch):
    """Forty copies of each point: as many rows of points go to slabs as there are places, hits are asked once for each of them, and links are those of the rule."""
    points = copied(7, 40)
    places = len({p[1:] for p in points})
    groups = one_merge._grouped(table(spark, points))
    assert groups.count() == places and len(one_merge.cuts(groups, 0.3, places)) == 0
    asked, hits = [], one_merge.Slab._hits
    monkeypatch.setattr(one_merge.Slab, "_hits", lambda self, scan, mz: asked.append(mz) or hits(self, scan, mz))
    slab = one_merge.Slab(0, 0.3, 2, 1, -np.inf, np.inf)
    for r in sorted(groups.collect(), key=lambda r: r[:3]):
        slab.take(one_merge.OWN, r.scan_ord, r.mz, r.peak_id, None, None, r.more)
    assert len(asked) == places
    rule, want = clustering.OnePass(0.3, 2, 1), set()
    for i, scan, mz in in_order(points):
        first = next(rule._hits(scan, mz), None)
        if first is not None:
            want.add((i, first))
        rule.add(i, scan, mz)
        rule.forget(scan - 2)
    got = [tuple(r) for r in one_merge.links(table(spark, points), 0.3, 2, 1, 50)[0].collect()]
    assert len(got) == len(set(got)) and want <= set(got)
