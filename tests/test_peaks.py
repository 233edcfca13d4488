"""Filters, numbering, deadtime, joins, clusters and grids on small frames."""

import math
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peakloom.functions import shared
from peakloom.functions.ranking import ordinals
from peakloom.functions.scalars import binomial, combinations, duration_seconds, int_abs, lenient_double, lenient_int
from peakloom.operators import asof, clustering, components, deadtime, grid, preprocess
from peakloom.operators.components import connected_components

PEAK = "peak_id long, scan_num int, rt double, mz double, intensity double"


def peaks(spark, rows):
    return spark.createDataFrame(rows, PEAK)


def test_filter_bounds_are_strict_and_floor_is_inclusive(spark):
    df = peaks(spark, [(1, 1, 0.0, 100.0, 9.0), (2, 1, 0.0, 100.5, 0.0), (3, 1, 0.0, 101.0, 5.0), (4, 1, 0.0, 200.0, 9.0), (5, 1, 0.0, 150.0, 4.9)])
    assert [r.peak_id for r in preprocess.filter_peaks(df, 100.0, 200.0).orderBy("peak_id").collect()] == [3, 5]
    assert [r.peak_id for r in preprocess.filter_peaks(df, 100.0, 200.0, floor=5.0).collect()] == [3]


def test_sampling_counts_scans_of_the_type_only(spark):
    rows = [(n, "calibration" if n == 3 else "Full", float(n), f"PT{n}S") for n in range(1, 8)]
    scans = spark.createDataFrame(rows, "num int, scan_type string, rt double, rt_text string")
    take = lambda **k: [(r.num, r.new_num) for r in preprocess.sample_scans(scans, **k).orderBy("num").collect()]
    assert take(take="even") == [(2, 1), (5, 2), (7, 3)]
    assert take(take="odd") == [(1, 1), (4, 2), (6, 3)]
    assert take(take="even", rt=(5.0, 7.0)) == [(5, 1), (7, 2)]
    assert take(num=(2, 4), renumber=False) == [(2, 2), (4, 4)]
    h = preprocess.run_header(scans).first()
    assert (h.scan_count, h.start_time, h.end_time) == (7, "PT1S", "PT7S")


def test_ordinals_are_dense(spark):
    values = random.Random(3).sample(range(100_000), 3000)
    got = {r.k: r.ordinal for r in ordinals(spark.createDataFrame([(v,) for v in values + values], "k long"), "k").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}
    assert ordinals(spark.createDataFrame([], "k long"), "k").count() == 0


def test_local_maxima_keep_plateaus_and_ends(spark):
    rows = [(i, 1, 0.0, float(i), v) for i, v in enumerate([3.0, 1.0, 4.0, 4.0, 2.0, 5.0])]
    assert [r.peak_id for r in preprocess.local_maxima(peaks(spark, rows)).orderBy("peak_id").collect()] == [0, 2, 3, 5]


def test_highest_peaks_suppress_neighbours(spark):
    rows = [(1, 1, 0.0, 100.0, 10.0), (2, 5, 0.0, 100.01, 20.0), (3, 50, 0.0, 100.0, 15.0), (4, 51, 0.0, 300.0, 1.0), (5, 51, 0.0, 200.0, 7.0)]
    got = [(r.scan_num, r.intensity) for r in preprocess.highest_peaks(peaks(spark, rows), n=3).orderBy("place").collect()]
    assert got == [(5, 20.0), (50, 15.0), (51, 7.0)]
    wide = [(r.scan_num, r.mz) for r in preprocess.highest_peaks(peaks(spark, [(1, 1, 0.0, 100.0, 9.0), (2, 2, 0.0, 100.9, 8.0)]), n=2, compat=True).collect()]
    assert wide == [(1, 100.0)]


@pytest.mark.parametrize("seed", range(4))
def test_cutting_candidates_changes_nothing(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(200), 0.0, round(rng.random() * 2, 3), float(rng.randrange(1, 60 if seed % 2 else 100_000))) for i in range(1500)]
    for compat in (False, True):
        cut, whole = ([tuple(r) for r in preprocess.highest_peaks(peaks(spark, rows), n=6, mz=0.05, compat=compat, cut=c).collect()] for c in (True, False))
        assert cut == whole


def test_fullest_scan_takes_the_first_tie(spark):
    rows = [(1, 2, 0.0, 1.0, 1.0), (2, 2, 0.0, 2.0, 1.0), (3, 1, 0.0, 1.0, 1.0), (4, 1, 0.0, 2.0, 1.0)]
    assert preprocess.fullest_scan(peaks(spark, rows)).first().scan_num == 1


def test_bright_clusters(spark):
    rows = [(1, s / 1.0, m / 1.0, 5.0) for s in range(2) for m in range(3)] + [(2, 0.0, 1.0, 9.0)]
    df = spark.createDataFrame(rows, "cluster_id long, rt double, mz double, intensity double")
    assert preprocess.bright_clusters(df, 3, 5.0, 2).count() == 6
    assert preprocess.bright_clusters(df, 3, 5.1, 2).count() == 0
    assert preprocess.bright_clusters(df, 4, 5.0, 2).count() == 0


def test_flight_constants():
    assert deadtime.flight_constant() == pytest.approx(1.0342342454e-6, rel=1e-9)
    assert deadtime.pulses() == pytest.approx(5111.1111111)


def close(n, start=400.0):
    """mz values so near that all lie within a few ns of each other."""
    return [start + 0.002 * i for i in range(n)]


def test_one_neighbour_gives_equal_results_and_two_do_not(spark):
    n, a = 1000.0, deadtime.flight_constant()
    for k, equal in ((2, True), (3, False)):
        mz, i = np.array(close(k)), np.full(k, 200.0)
        one = deadtime.recurrence(mz, i, 7.5e-11, 0.0, n, a)  # reaches the next peak only
        two = deadtime.recurrence(mz, i, 7.5e-11, 7.5e-11, n, a)
        assert np.allclose(one, two, rtol=1e-12) == equal
        assert (one >= i).all() and (two >= i).all()


def plain_recurrence(mz, intensity, tau_ne, tau_e, n, a):
    """Both deadtimes by two plain loops."""
    t, out = [a * math.sqrt(m) for m in mz], []
    for i in range(len(mz)):
        free, blocked = n, 0.0
        for j in range(i):
            if t[i] - t[j] <= tau_e and t[i] - t[j] <= tau_ne:
                blocked += out[j]
            elif t[i] - t[j] <= tau_ne:
                free -= intensity[j]
        x = 1 - intensity[i] * math.exp(blocked / n) / free if free > 0 and blocked == blocked else math.nan
        out.append(-n * math.log(x) if x > 0 else math.nan)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_recurrence_against_plain_loops(spark, seed):
    rng = random.Random(seed)
    mz = sorted(400 + rng.random() * 0.05 for _ in range(80))
    mz[7] = mz[6]
    raw = [float(rng.randint(1, 50)) for _ in mz]
    raw[6:8] = sorted(raw[6:8])
    n, a = (60.0 if seed % 2 else 900.0), deadtime.flight_constant()
    for tau_ne, tau_e in ((5e-10, 1e-10), (5e-10, 0.0), (3e-10, 3e-10), (2e-10, 9e-10)):
        got, want = deadtime.recurrence(np.array(mz), np.array(raw), tau_ne, tau_e, n, a), plain_recurrence(mz, raw, tau_ne, tau_e, n, a)
        assert np.allclose(got, want, rtol=1e-9, equal_nan=True) and (seed % 2 == 0 or np.isnan(want).any())
    points = spark.createDataFrame([(seed, 1.5, m, i) for m, i in zip(mz, raw, strict=True)], "cluster_id long, rt double, mz double, intensity double")
    want = plain_recurrence(mz, raw, 5e-10, 1e-10, n, a)
    fixed = [r.corrected for r in deadtime.correct_clusters(points, 5e-10, 1e-10, n).orderBy("mz", "intensity").collect()]
    assert np.allclose(sorted(fixed), sorted(raw if np.isnan(want).any() else want), rtol=1e-9)


def test_window_form_equals_recurrence(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, 0.0, 400 + rng.random() * 0.05, float(rng.randint(1, 50))) for i in range(120)]
    n = 5000.0
    got = {r.peak_id: r.corrected for r in deadtime.correct_nonextending(peaks(spark, rows), 5e-9, n).collect()}
    for scan in range(3):
        own = sorted((r for r in rows if r[1] == scan), key=lambda r: r[3])
        want = deadtime.recurrence(np.array([r[3] for r in own]), np.array([r[4] for r in own]), 5e-9, 0.0, n, deadtime.flight_constant())
        assert np.allclose([got[r[0]] for r in own], want, rtol=1e-9)


def test_saturation_is_null_and_clusters_keep_originals(spark):
    rows = [(1, 1, 0.0, 400.0, 90.0), (2, 1, 0.0, 400.001, 90.0)]
    got = [r.corrected for r in deadtime.correct_nonextending(peaks(spark, rows), 5e-9, 100.0).orderBy("mz").collect()]
    assert got[0] == pytest.approx(-100 * math.log(0.1)) and got[1] is None
    points = spark.createDataFrame([(1, 0.0, 400.0, 90.0), (1, 0.0, 400.001, 90.0), (2, 0.0, 400.0, 10.0)], "cluster_id long, rt double, mz double, intensity double")
    fixed = {(r.cluster_id, r.mz): r.corrected for r in deadtime.correct_clusters(points, 5e-9, 0.0, 100.0).collect()}
    assert fixed[1, 400.0] == 90.0 and fixed[1, 400.001] == 90.0 and fixed[2, 400.0] > 10.0


def test_duplicates_merge(spark):
    got = deadtime.merge_duplicates(peaks(spark, [(1, 1, 0.0, 5.0, 2.0), (2, 1, 0.0, 5.0, 3.0)])).collect()
    assert [(r.mz, r.intensity) for r in got] == [(5.0, 5.0)]


def test_link_bounds_and_gaps(spark):
    d = 0.0625
    rows = [(1, 0, 1.0, 10.0), (2, 1, 1.0, 10.0 + d), (3, 2, 1.0, 10.0 - d), (4, 3, 1.0, 10.0), (5, 1, 1.0, 10.5)]
    df = spark.createDataFrame(rows, "peak_id long, scan_ord int, rt double, mz double")
    got = {(r.a, r.b) for r in clustering.link_edges(df, d).collect()}
    assert got == {(2, 1), (3, 1), (4, 2), (4, 3)}


def brute_components(edges):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {x: top(x) for x in list(root)}


def test_components_against_union_find(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, i) for i in range(2001, 2080)] + [(5, 5), (7000, 7000), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = brute_components([e for e in edges if None not in e])
    assert {r.node: r.component for r in connected_components(df).collect()} == want
    assert {r.node: r.component for r in connected_components(df.coalesce(1)).collect()} == want
    monkeypatch.setattr(components, "CHUNK", 8)  # contractions that leave most to the rounds
    assert {r.node: r.component for r in connected_components(df.coalesce(1)).collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contraction_in_pieces(monkeypatch):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(350)]
    batches = [pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges[i : i + 25]], pa.int64()) for k in (0, 1)], ["u", "v"]) for i in range(0, 350, 25)]
    for chunk in (1 << 20, 100, 40):
        monkeypatch.setattr(components, "CHUNK", chunk)
        stars = [e for b in components._contract(iter(batches)) for e in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)]
        want, got = brute_components(edges), brute_components(stars)
        assert all(got.get(x, x) == c for x, c in want.items()) and all(u > v for u, v in stars)
        assert len(stars) == len(want) - len(set(want.values())) or chunk < 400


def test_run_folders_are_removed(spark):
    with shared.run_folder(spark) as path:
        table = shared.written(spark.range(5), "x")
        assert table.count() == 5
        assert Path(path.removeprefix("file://")).is_dir()
    assert not Path(path.removeprefix("file://")).exists()
    assert shared.written(spark.range(3), "y").count() == 3


def test_ordinals_of_any_type_and_outliers(spark):
    values = [0, *(1_700_000_000 + i for i in range(500)), (1 << 60) + 1, (1 << 60) + 2]
    got = {r.k: r.ordinal for r in ordinals(spark.createDataFrame([(v,) for v in values], "k long"), "k", kind="bigint").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}
    got = {tuple(r.k): r.ordinal for r in ordinals(spark.createDataFrame([([2, 1],), ([2],), ([1, 9],)], "k array<long>"), "k").collect()}
    assert got == {(1, 9): 0, (2,): 1, (2, 1): 2}


def test_run_ordinals_follow_lines(spark):
    rng = random.Random(2)
    rts = []
    for _ in range(120):
        rts += [float(rng.randrange(4))] * rng.randrange(1, 5)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rts)], "line int, rt double").repartition(6)
    want, n = [], 0
    for i, t in enumerate(rts):
        n += bool(i) and t != rts[i - 1]
        want.append(n)
    assert [r.scan_ord for r in clustering.with_run_ordinals(df, "line").orderBy("line").collect()] == want


def test_ordered_grid_takes_each_bin_once(spark):
    rng = random.Random(5)
    rows = [(s, k, round(rng.random() * 30, 3)) for s in range(3) for k in range(40)]
    got = {(r.scan_num, r.peak_id): r.bin for r in grid.grid_matches_in_order(spark.createDataFrame(rows, "scan_num int, peak_id int, mz double"), 1.0, 0.25, 15, 0.4).collect()}
    mzs, want = [(1 + i * 0.25) ** 2 for i in range(16)], {}
    for s in range(3):
        free = 0
        for _, k, mz in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])):
            if mzs[0] - 0.4 <= mz <= mzs[15] + 0.4:
                c = next((c for c in range(free, 15) if abs(mzs[c] - mz) < 0.4), None)
                if c is not None:
                    want[s, k], free = c, c + 1
    assert got == want


def global_rule(points, d, n_prev, max_merges):
    """The one-pass rule over all points, with plain lists."""
    colour, out = {}, []
    for pid, o, m in sorted(points, key=lambda p: (p[1], p[2], p[0])):
        hits = [q for k in range(1, n_prev + 1) for q in sorted((x for x in out if x[1] == o - k and abs(x[2] - m) <= d), key=lambda x: x[2])]
        mine, merges = None, 0
        for q in hits:
            c = colour[q[0]]
            if mine is None:
                mine = c
            elif c != mine:
                colour.update({p: mine for p, x in colour.items() if x == c})
                merges += 1
                if max_merges is not None and merges >= max_merges:
                    break
        colour[pid] = pid if mine is None else mine
        out.append((pid, o, m))
    groups = {}
    for p, c in colour.items():
        groups.setdefault(c, []).append(p)
    return {p: min(g) for g in groups.values() for p in g}


@pytest.mark.parametrize("max_merges", [None, 1])
def test_clusters_against_the_global_rule(spark, max_merges):
    rng = random.Random(11)
    points = [(i, rng.randrange(12), round(rng.random() * 4, 2)) for i in range(260)]
    df = spark.createDataFrame(points, "peak_id long, scan_ord int, mz double")
    got = {r.peak_id: r.cluster_id for r in clustering.cluster(df, 0.25, 2, 1, max_merges).collect()}
    assert got == global_rule(points, 0.25, 2, max_merges)


def test_size_limit_counts_whole_clusters(spark):
    points = [(i, i, 5.0) for i in range(20)] + [(100 + i, i, 9.0) for i in range(19)]
    df = spark.createDataFrame(points, "peak_id long, scan_ord int, mz double").withColumn("intensity", F.lit(3.0))
    k = clustering.cluster(df)
    assert {r.cluster_id for r in k.collect()} == {0} and k.count() == 20
    assert [(r.cluster_id, r.n_points, r.n_scans, r.max_intensity) for r in clustering.cluster_sizes(k).collect()] == [(0, 20, 20, 3.0)]
    assert clustering.orphans(k).count() == 0
    assert clustering.last_seen(k).first().last_seen == 19


def test_orphans_are_found_and_duplicates_are_partners(spark):
    rows = [(1, 1, 0, 5.0), (2, 1, 9, 5.0), (3, 2, 0, 5.0), (4, 2, 0, 5.0)]
    df = spark.createDataFrame(rows, "peak_id long, cluster_id long, scan_ord int, mz double")
    assert sorted(r.peak_id for r in clustering.orphans(df).collect()) == [1, 2]


@pytest.mark.parametrize("mode", asof.MODES)
def test_asof_of_repeated_keys_takes_the_least_value(spark, mode):
    left = spark.createDataFrame([(1, 5.0), (2, 6.0)], "i int, k double")
    right = spark.createDataFrame([(5.0, 9), (5.0, 3), (5.0, 7), (7.0, 8), (7.0, 2), (5.0, None)], "k double, v int").repartition(3)
    want = {">": [2, 2], ">=": [3, 2], "=": [3, None], "<=": [3, 3], "<": [None, 3]}[mode]
    assert [r.found for r in asof.asof(left, right, "k", "v", mode).orderBy("i").collect()] == want


@pytest.mark.parametrize("mode, want", [("<=", [None, 10, 10, 20]), ("<", [None, None, 10, 10]), ("=", [None, 10, None, 20]), (">=", [10, 10, 20, 20]), (">", [10, 20, 20, None])])
def test_asof_modes(spark, mode, want):
    left = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, 1.5), (4, 2.0)], "i int, k double")
    right = spark.createDataFrame([(1.0, 10), (2.0, 20)], "k double, v int")
    assert [r.found for r in asof.asof(left, right, "k", "v", mode).orderBy("i").collect()] == want


@pytest.mark.parametrize("mode", ["<=", "<", ">=", ">"])
def test_asof_over_ranges(spark, mode):
    rng = random.Random(len(mode) + ord(mode[0]))
    left = [(i, float(rng.randrange(-50, 900))) for i in range(400)]
    right = [(float(k), k) for k in rng.sample(range(100, 800, 5), 30)]
    got = {r.i: r.found for r in asof.asof(spark.createDataFrame(left, "i int, k double"), spark.createDataFrame(right, "k double, v int"), "k", "v", mode).collect()}
    for i, k in left:
        near = [v for q, v in right if (q <= k if mode == "<=" else q < k if mode == "<" else q >= k if mode == ">=" else q > k)]
        assert got[i] == ((max if mode[0] == "<" else min)(near) if near else None)
    assert asof.asof(spark.createDataFrame(left, "i int, k double"), spark.createDataFrame([], "k double, v int"), "k", "v", mode).where("found is not null").count() == 0


def test_neighbours_across_cells(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(sorted(rng.random() * 500 for _ in range(300)))]
    got = {r.scan_num: (r.lo_scan, r.hi_scan) for r in asof.neighbour_range(spark.createDataFrame(rows, "scan_num int, rt double"), 7.5).collect()}
    assert got == {i: (min(j for j, u in rows if abs(u - t) <= 7.5), max(j for j, u in rows if abs(u - t) <= 7.5)) for i, t in rows}


def test_block_edges_fall_out(spark):
    df = peaks(spark, [(i, 1, 0.0, float(m), 1.0) for i, m in enumerate([1, 2, 4, 6, 9])])
    assert [(r.mz, r.block) for r in grid.mz_blocks(df, 1.0, 9.0, 2).orderBy("mz").collect()] == [(2.0, 1), (6.0, 2)]


def test_grids(spark):
    df = peaks(spark, [(1, 1, 0.0, 1.0, 2.0), (2, 1, 0.0, 4.0, 3.0), (3, 1, 0.0, 4.0, 4.0), (4, 2, 0.0, 9.3, 5.0)])
    assert sorted((r.scan_num, r.bin, r.intensity, r.n_peaks) for r in grid.tof_grid(df, 1.0, 1.0).collect()) == [(1, 0, 2.0, 1), (1, 1, 7.0, 2), (2, 2, 5.0, 1)]
    assert sorted(r.peak_id for r in grid.grid_matches(df, 1.0, 1.0, 0.1).collect()) == [1, 2]
    assert 4 in [r.peak_id for r in grid.grid_matches(df, 1.0, 1.0, 0.1, compat=True).collect()]
    assert {r.scan_num: r.gap for r in grid.least_gap(df).collect()}[1] == 0.0


def test_scalars(spark):
    t = spark.createDataFrame([("PT1.5S",), ("PT2M3S",), ("P1DT2H",), ("P1Y2M3DT4H",), ("-PT5S",), (None,)], "t string")
    assert [r[0] for r in t.select(duration_seconds(F.col("t"))).collect()] == [1.5, 123.0, 93600.0, 31104000 + 5184000 + 259200 + 14400, 5.0, None]
    assert t.where("t = 'P1DT2H'").select(duration_seconds(F.col("t"), True)).first()[0] == 7200.0
    n = spark.createDataFrame([("12abc", -1.7), ("x", 0.4), (" -3.5e1z", 2.0)], "s string, x double")
    assert [tuple(r) for r in n.select(lenient_int(F.col("s")), lenient_double(F.col("s")), int_abs(F.col("x"))).collect()] == [(12, 12.0, 1.0), (0, 0.0, 0.0), (-3, -35.0, 2.0)]
    c = spark.range(1).select(combinations(F.lit(5), F.lit(2)), combinations(F.lit(2), F.lit(3)), combinations(F.lit(4), F.lit(0)), binomial(F.lit(4), F.lit(2), F.lit(0.5))).first()
    assert tuple(c) == (10.0, 0.0, 1.0, 0.375)
