"""Components over tiles, and what is derived from one large cluster, against plain loops."""

import random

import numpy as np
import pytest

from peakloom.functions.ranking import places
from peakloom.operators import bands, clustering
from peakloom.sources import text


def table(spark, rows):
    return spark.createDataFrame(rows, "peak_id long, scan_ord int, mz double")


def labels(rows, d, n_prev):
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s, m in rows:
        for j, t, z in rows:
            if 1 <= s - t <= n_prev and -d <= z - m <= d:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


@pytest.mark.parametrize(("seed", "tile", "wide"), [(1, 40, 25.0), (2, 60, 6.0), (3, 1 << 19, 12.0)])
def test_components_over_tiles(spark, seed, tile, wide):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(30), round(rng.random() * wide, 1)) for i in rng.sample(range(10_000), 500)]
    got = {r.peak_id: r.cluster_id for r in bands.components_of_links(table(spark, rows), 0.2, 2, tile).collect()}
    assert got == labels(rows, 0.2, 2)


def test_copies_cost_no_links():
    """60,000 points of three scans, all within reach: 2.4 billion links, which are not listed."""
    n = 60_000
    ids = np.arange(n)[::-1].copy()
    assert (bands.scan_links(np.arange(n) % 3, np.linspace(0, 1, n), ids, 2.0, 2) == 0).all()


def test_points_that_reach_nothing(spark):
    rows = [(1, 0, 1.0), (2, 1, float("nan")), (3, 1, None), (4, None, 1.0), (5, 1, float("inf")), (6, 2, 1.0)]
    got = {r.peak_id: r.cluster_id for r in clustering.cluster(table(spark, rows), 0.5, 2, 1).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 1}


def test_spans_compare_differences():
    values = np.unique(np.round(np.random.default_rng(0).random(400) * 9, 2))
    lo, hi = bands.spans(values, 0.02)
    near = np.abs(values[None, :] - values[:, None]) <= 0.02
    assert (lo == near.argmax(1)).all() and (hi == len(values) - 1 - near[:, ::-1].argmax(1)).all()


@pytest.mark.parametrize("by_text", [False, True])
def test_plot_lines_of_one_cluster_over_ranges(spark, by_text):
    """A cluster that several ranges hold: lines go on from one to the next."""
    rng = random.Random(5)
    rows = [(i, 7 if i < 900 else 8, float(rng.randrange(9)), rng.randrange(60) / 16) for i in range(1000)]
    df = spark.createDataFrame(rows, "peak_id long, cluster_id long, rt double, mz double").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.peak_id: r.line for r in text.plot_table(df, by_text).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, last, line = {}, (None, None), 0
    for i, k, _, m in sorted(rows, key=lambda r: (r[1], f"{r[3]:.3f}" if by_text else r[3], r[2], r[3], r[0])):
        line = (line if k == last[0] else 0) + ((k, m) != last)
        last, want[i] = (k, m), line
    assert got == want


def test_orphans_against_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i, i % 3, rng.randrange(40), rng.randrange(800) / 100) for i in range(500)]
    df = spark.createDataFrame(rows, "peak_id long, cluster_id long, scan_ord int, mz double")
    want = {p for p, k, o, m in rows if not any(p != q and k == c and abs(o - s) <= 1 and abs(m - z) <= 0.1 for q, c, s, z in rows)}
    assert {r.peak_id for r in clustering.orphans(df, 1, 0.1).collect()} == want and 0 < len(want) < 500


def test_places_of_one_value_over_ranges(spark):
    df = spark.createDataFrame([(k, float(x * 37 % 101)) for k in (1, 2) for x in range(101)], "k long, x double").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = places(df, "k", ["x"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 202 and all(r.place == r.x + 1 for r in got)
