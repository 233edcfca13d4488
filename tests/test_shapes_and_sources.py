"""Annealing, curvature, Gaussians, isotopes, files, mzXML and the stream clusterer."""

import base64
import math
import random
import struct
from datetime import datetime, timezone
from xml.etree import ElementTree

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peakloom.operators import anneal, clustering, curvature, deadtime, isotopes, preprocess, shapes
from peakloom.sources import mzxml, text
from peakloom.streaming.clusterer import OpenClusters, cluster_stream


def one_d(x):
    return float(math.cos(14.5 * x[0] - 0.3) + (x[0] + 0.2) * x[0])


def two_d(x):
    return float(math.cos(14.5 * x[0] - 0.3) + (x[1] + 0.2) * x[1] + (x[0] + 0.2) * x[0])


@pytest.mark.parametrize("schedule", ["fast", "cauchy", "boltzmann"])
def test_annealer_finds_the_known_minima(schedule):
    best = min((anneal.anneal(one_d, [-3.0], [3.0], schedule, seed=s) for s in range(5)), key=lambda r: r.cost)
    assert best.x[0] == pytest.approx(-0.195, abs=0.02)
    best = min((anneal.anneal(two_d, [-3.0, -3.0], [3.0, 3.0], schedule, seed=s) for s in range(8)), key=lambda r: r.cost)
    assert np.allclose(best.x, [-0.195, -0.1], atol=0.1)


def test_annealer_stop_codes():
    assert anneal.anneal(one_d, [-3.0], [3.0], max_eval=10).code == anneal.MAX_EVAL
    assert anneal.anneal(one_d, [-3.0], [3.0], max_iter=1, feps=0.0).code == anneal.MAX_ITER
    with pytest.raises(KeyError):
        anneal.anneal(one_d, [-3.0], [3.0], "unknown")


def test_centroid_and_curvature(spark):
    rows = [(1, float(t), 500.0 + 0.1 * t + k, float(1 + k)) for t in range(8) for k in range(3)]
    df = spark.createDataFrame(rows, "cluster_id long, rt double, mz double, intensity double")
    trace = curvature.centroids(df)
    assert trace.where("rt = 0").first().mz == pytest.approx((500 + 2 * 501 + 3 * 502) / 6)
    assert curvature.centroids(df, centroid="max").where("rt = 0").first().mz == 502.0
    assert abs(curvature.cluster_curvature(trace).first().curvature) < 1e-8
    t = np.linspace(0, 9, 10)
    p = np.array([0.001, -0.02, 0.3, 500.0])
    assert curvature.trace_curvature(t, np.polyval(p, t)) == pytest.approx(curvature.curvature(p, t).sum(), rel=1e-6)
    m = curvature.moments(trace).first()
    assert m.n == 8 and m.t2 == sum(i * i for i in range(8))


def plain_objective(points, parameters):
    """The objective cluster by cluster with a polynomial fit each."""
    tau_ne, tau_e, n, a = parameters
    total = 0.0
    for _, cluster in points.groupby("cluster_id"):
        rts, mzs = [], []
        for rt, s in cluster.sort_values(["rt", "mz", "intensity"]).groupby("rt"):
            mz, raw = s["mz"].to_numpy(), s["intensity"].to_numpy()
            fixed = deadtime.recurrence(mz, raw, tau_ne * 1e-9, tau_e * 1e-9, n, a)
            rts.append(rt)
            mzs.append(np.average(mz, weights=raw if np.isnan(fixed).any() else fixed))
        total += abs(curvature.trace_curvature(np.array(rts), np.array(mzs))) if len(rts) > 3 else 0.0
    return total


def long_clusters(spark):
    rng = random.Random(7)
    rows = [(c, float(t), 500.0 + 0.01 * k + 0.002 * rng.random(), 20.0 + 100 * rng.random()) for c in range(80) for t in range(6 - c % 4) for k in range(1 + (c + t) % 6)]
    return spark.createDataFrame(rows, "cluster_id long, rt double, mz double, intensity double")


def test_deadtime_grid_sums_over_all_clusters(spark, monkeypatch):
    df = long_clusters(spark)
    points = df.toPandas()
    n, a = deadtime.pulses(), deadtime.flight_constant()
    for few in (n, 200.0):  # saturated spectra too
        assert anneal.Spectra(points).objective(np.array([5.0, 2.0, few, a])) == pytest.approx(plain_objective(points, (5.0, 2.0, few, a)), rel=1e-6)
    got = {(r.tau_ne_ns, r.tau_e_ns): r.cost for r in anneal.grid_search(df, [3.0, 7.0], [0.0, 0.5, 3.0]).collect()}
    assert len(got) == 6
    for x, y in got:
        assert got[x, y] == pytest.approx(plain_objective(points, (x, y, n, a)), rel=1e-6)
    none = anneal.grid_search(df.where("cluster_id < 0"), [3.0], [0.5, 1.0]).collect()
    assert all(r.cost == 0.0 for r in none)


def test_deadtime_search_works_on_all_clusters(spark, monkeypatch):
    df = long_clusters(spark)
    rows = anneal.search_deadtime(df, restarts=2).collect()
    points = df.toPandas()
    for r in rows:
        assert r.cost == pytest.approx(plain_objective(points, (r.tau_ne_ns, r.tau_e_ns, r.pulses, r.flight_constant)), rel=1e-6)
        assert r.evaluations > 400 and 3 < r.tau_ne_ns < 7 and 0.5 < r.tau_e_ns < 3
        n, a = deadtime.pulses(), deadtime.flight_constant()
        assert r.cost <= min(plain_objective(points, (x, y, n, a)) for x in (4.0, 5.0, 6.0) for y in (1.0, 2.0)) * 1.02
    monkeypatch.setattr(anneal, "MOST_POINTS", 10)
    with pytest.raises(ValueError):
        anneal.search_deadtime(df)


def test_gaussians_are_recovered(spark):
    rt, mz = np.meshgrid(np.linspace(0, 40, 21), np.linspace(500, 500.4, 21))
    z = 90 * np.exp(-(((20 - rt) / 6) ** 2 + ((500.2 - mz) / 0.07) ** 2) / 2)
    rows = [(7, float(a), float(b), float(c)) for a, b, c in zip(rt.ravel(), mz.ravel(), z.ravel(), strict=True)]
    df = spark.createDataFrame(rows, "cluster_id long, rt double, mz double, intensity double")
    f = shapes.fit_gaussians(df, bandwidth=1.0).first()
    assert f.converged and f.rt == pytest.approx(20, abs=1e-3) and f.mz == pytest.approx(500.2, abs=1e-5)
    assert abs(f.rt_width) == pytest.approx(6, rel=1e-3) and f.height == pytest.approx(90, rel=1e-3) and f.volume == pytest.approx(z.sum(), rel=1e-3)


def test_fits_are_least_squares():
    """Two overlapping Gaussians and noise: no nearby parameters give a smaller sum of squares."""
    rng = np.random.default_rng(4)
    x, y = (g.ravel() for g in np.meshgrid(np.linspace(0, 40, 17), np.linspace(500, 500.6, 15)))
    z = shapes.gaussians(np.array([12, 500.2, 5, 0.06, 80, 28, 500.4, 6, 0.08, 50.0]), x, y).sum(0) + rng.normal(0, 0.5, len(x))
    p, ok = shapes.levenberg(np.array([10, 500.15, 4, 0.05, 60, 30, 500.45, 4, 0.05, 60.0]), x, y, z)
    cost = lambda q: float(((z - shapes.gaussians(q, x, y).sum(0)) ** 2).sum())
    assert ok and np.allclose(p, [12, 500.2, 5, 0.06, 80, 28, 500.4, 6, 0.08, 50], rtol=0.05)
    scale = np.array([5, 0.06, 5, 0.06, 80, 6, 0.08, 6, 0.08, 50])
    assert all(cost(p + scale * step) >= cost(p) * (1 - 1e-9) for size in (1e-2, 1e-3, 1e-4) for step in rng.normal(0, size, (60, 10)))


def plain_mean_shift(points, bandwidth):
    """Flat-kernel mean shift from rounded seeds with plain loops."""
    near = lambda c: [p for p in points if math.dist(p, c) <= bandwidth]
    found = {}
    for seed in sorted({tuple(round(v / bandwidth) for v in p) for p in points}):
        c = tuple(v * bandwidth for v in seed)
        for _ in range(300):
            inside = near(c)
            if not inside:
                break
            new = tuple(sum(v) / len(inside) for v in zip(*inside, strict=True))
            moved, c = math.dist(new, c), new
            if moved <= 1e-3 * bandwidth:
                break
        if near(c):
            found[tuple(round(v, 9) for v in c)] = len(near(c))
    centres = []
    for c, _ in sorted(found.items(), key=lambda kv: (-kv[1], kv[0])):
        if all(math.dist(c, o) > bandwidth for o in centres):
            centres.append(c)
    return [min(range(len(centres)), key=lambda k: math.dist(p, centres[k])) for p in points]


@pytest.mark.parametrize("seed", range(4))
def test_mean_shift_against_plain_loops(spark, seed):
    rng = random.Random(seed)
    points = [(round(c[0] + rng.gauss(0, 0.03), 4), round(c[1] + rng.gauss(0, 0.03), 4)) for c in ((0.0, 0.0), (0.3, 0.1), (0.9, 0.9)) for _ in range(15)]
    want = plain_mean_shift(points, 0.08)
    got = shapes.mean_shift(np.array(points), 0.08)
    assert len(set(got.tolist())) == len(set(want)) and len(set(zip(got.tolist(), want, strict=True))) == len(set(want))
    df = spark.createDataFrame([(7, x * shapes.RT_SCALE, y) for x, y in points], "cluster_id long, rt double, mz double")
    assert shapes.mean_shift_counts(df, 0.08).first().subclusters == len(set(want))


def test_counts_of_subclusters(spark):
    rng = random.Random(2)
    rows = [(i, 1, c * 75.0 + rng.random() * 0.2, 500 + c + rng.random() * 0.004, 1.0) for c in range(3) for i in range(c * 20, c * 20 + 20)] + [(900, 1, 5000.0, 800.0, 1.0)]
    df = spark.createDataFrame(rows, "peak_id long, cluster_id long, rt double, mz double, intensity double")
    assert shapes.mean_shift_counts(df).first().subclusters == 4
    assert tuple(shapes.density_counts(df).first()) == (1, 3, 1)


def test_composition_and_mass(spark):
    rows = spark.createDataFrame([(1, "G", 1), (2, "GX", 1), (3, "ACDEFGHIKLMNPQRSTVWY", 2), (4, "", 1)], "seq_id long, sequence string, charge int")
    got = {r.seq_id: r for r in isotopes.with_mass(isotopes.composition(rows)).collect()}
    assert (got[1].c, got[1].h, got[1].n, got[1].o, got[1].s, got[1].deut) == (2, 6, 1, 2, 0, 4)
    assert got[2].mass == got[1].mass
    assert got[3].c == sum(a[0] for a in isotopes.RESIDUES.values()) and got[3].s == 2


def test_isotope_percentages():
    full = isotopes.isotope_percent({"c": 40, "h": 60, "n": 10, "o": 12, "s": 1})
    assert full.sum() == pytest.approx(100, abs=0.01) and full[-1] < 0.005 <= full[-2]
    assert isotopes.isotope_percent({"c": 1, "h": 0, "n": 0, "o": 0, "s": 0})[:2] == pytest.approx([98.893, 1.107])
    heavy = isotopes.isotope_percent({"c": 2000, "h": 0, "n": 0, "o": 0, "s": 0})
    assert heavy.argmax() >= 20  # the mode is not cut off


def test_profiles(spark):
    rows = spark.createDataFrame([(1, "GKR", 2), (2, "A", 9)], "seq_id long, sequence string, charge int")
    atoms = isotopes.composition(rows)
    fast = {(r.seq_id, r.idx): r.pct for r in isotopes.fast_exchange(atoms, 10.0).collect()}
    assert fast[2, 0] == pytest.approx(100 * 0.9**4) and sum(v for (s, _), v in fast.items() if s == 1) == pytest.approx(100)
    both = isotopes.profiles(rows).where("seq_id = 1").orderBy("idx").collect()
    assert max(r.pct_norm for r in both) == pytest.approx(100)
    m = isotopes.with_mass(atoms).where("seq_id = 1").first().mass
    assert both[1].mz == pytest.approx((m + 1.003355 + 1) / 2)
    clamped = spark.createDataFrame([(0,), (8,), (7,)], "z int").select(isotopes.clamp_charge(F.col("z"))).collect()
    assert [r[0] for r in clamped] == [1, 1, 7]


def test_text_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1 0.500 400.000 20.000\nnot a peak\n1 0.500 400.5 x\n2 1.000 401.25 5\n")
    got = [tuple(r) for r in text.read_peaks(spark, str(tmp_path / "p.txt")).orderBy("mz").collect()]
    assert got == [(1, 0.5, 400.0, 20.0), (2, 1.0, 401.25, 5.0)]
    text.write_peaks(text.read_peaks(spark, str(tmp_path / "p.txt")), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1 0.500 400.000 20.000", "2 1.000 401.250 5.000"]
    folder = tmp_path / "c" / "deep"
    folder.mkdir(parents=True)
    (folder / "000012.clust").write_text("     3     1.500   400.000    20.000\nrubbish\n")
    (folder / "12.clust").write_text("     3     1.500   400.000    20.000\n")
    got = text.read_clusters(spark, str(tmp_path / "c"), recursive=True)
    assert [tuple(r) for r in got.collect()] == [(12, 3, 1.5, 400.0, 20.0)]
    with pytest.raises(Exception, match="not a point"):
        text.read_clusters(spark, str(tmp_path / "c"), strict=True, recursive=True).collect()
    text.write_clusters(got, str(tmp_path / "cw"))
    assert spark.read.text(str(tmp_path / "cw")).first().value == "     3     1.500   400.000    20.000"
    (tmp_path / "list").write_text("a.clust b.clust\nc.txt\n\n")
    assert [r.path for r in text.read_file_list(spark, str(tmp_path / "list")).collect()] == ["a.clust", "c.txt"]
    every = text.read_file_list(spark, str(tmp_path / "list"), first_only=False)
    assert [r.path for r in every.collect()] == ["a.clust", "b.clust", "c.txt"]
    assert [r.path for r in text.existing_clusters(every, spark.createDataFrame([("a.clust",), ("c.txt",)], "path string")).collect()] == ["a.clust"]
    (tmp_path / "seq").write_text("GAK 2\nPEPTIDE\n")
    assert [tuple(r) for r in text.read_sequences(spark, str(tmp_path / "seq")).collect()] == [(0, "GAK", 2), (1, "PEPTIDE", 1)]
    (tmp_path / "ab").write_text("C 0 0.98893 12.0\nC 1 0.01107 13.00335\n")
    assert [tuple(r) for r in text.read_abundances(spark, str(tmp_path / "ab")).collect()] == [("C", 1, 0.01107, 13.00335)]
    text.discard(got)
    text.write_blocks(got.withColumn("block", F.col("scan_ord") % 2), str(tmp_path / "blocks"))
    assert spark.read.parquet(str(tmp_path / "blocks")).select("block", "cluster_id").first()[:] == (1, 12)


def test_plot_lines(spark):
    df = spark.createDataFrame([(1, 0.0, 1000.0), (1, 1.0, 1000.0), (1, 0.0, 200.0)], "cluster_id long, rt double, mz double")
    assert {(r.rt, r.mz): r.line for r in text.plot_table(df).collect()} == {(0.0, 200.0): 1, (0.0, 1000.0): 2, (1.0, 1000.0): 2}
    assert {(r.rt, r.mz): r.line for r in text.plot_table(df, by_text=True).collect()}[0.0, 1000.0] == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1e6, width=32), st.floats(0, 1e6, width=32)), max_size=30), st.sampled_from([32, 64]), st.sampled_from(["none", "zlib"]))
def test_peak_lists_round_trip(pairs, precision, compression):
    packed, _ = mzxml.pack(np.array(pairs, np.float64), precision, compression)
    assert mzxml.unpack(packed, precision, compression).tolist() == [list(p) for p in pairs]


def test_known_peak_list_and_broken_ones():
    assert mzxml.unpack("Q8gAAEGgAAA=", 32, "none").tolist() == [[400.0, 20.0]]
    assert mzxml.unpack("Q8gA\nAEGg AAA=", 32, None).tolist() == [[400.0, 20.0]]
    with pytest.raises(ValueError):
        mzxml.unpack(base64.b64encode(struct.pack(">f", 1.0)).decode(), 32, "none")


DOC = """<?xml version="1.0"?><mzXML><msRun scanCount="4" startTime="PT1S" endTime="PT4S">
<scan num="1" scanType="Full" retentionTime="PT1.5S" peaksCount="1"><peaks precision="32" compressionType="none" compressedLen="0">Q8gAAEGgAAA=</peaks>
<scan num="2" scanType="calibration" retentionTime="PT2S" peaksCount="0"><peaks precision="32"></peaks></scan></scan>
<scan num="3" scanType="Full" retentionTime="PT0M3S" peaksCount="2"><peaks precision="64" compressionType="zlib" compressedLen="32">{}</peaks></scan>
</msRun></mzXML>"""


def test_mzxml(spark, tmp_path):
    (tmp_path / "a.mzXML").write_text(DOC.format(mzxml.pack(np.array([[1.0, 2.0], [3.0, 4.0]]), 64, "zlib")[0]))
    scans = mzxml.read_scans(spark, str(tmp_path / "a.mzXML"))
    assert sorted((r.num, r.scan_type, r.rt) for r in scans.collect()) == [(1, "Full", 1.5), (2, "calibration", 2.0), (3, "Full", 3.0)]
    peaks = mzxml.explode_peaks(mzxml.decode_scans(scans.where("scan_type = 'Full'")))
    assert sorted((r.scan_num, r.mz, r.intensity) for r in peaks.collect()) == [(1, 400.0, 20.0), (3, 1.0, 2.0), (3, 3.0, 4.0)]
    mzxml.write_mzxml(mzxml.encode_scans(peaks, 64), str(tmp_path / "out"), renumber=False)
    again = mzxml.explode_peaks(mzxml.decode_scans(mzxml.read_scans(spark, str(tmp_path / "out"))))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, peaks.collect()))


def test_mzxml_documents(spark, tmp_path):
    deep = DOC.replace("</peaks></scan></scan>", '</peaks><scan num="7" scanType="Full" retentionTime="PT2.5S" msLevel="3" filterLine="a &amp; &quot;b&quot;" basePeakMz="4"><peaks precision="32">Q8gAAEGgAAA=</peaks></scan></scan></scan>')
    (tmp_path / "deep.mzXML").write_text(deep.format(mzxml.pack(np.array([[1.0, 2.0], [3.0, 4.0]]), 64, "zlib")[0]))
    scans = mzxml.read_scans(spark, str(tmp_path / "deep.mzXML"))
    assert [r.num for r in scans.orderBy("doc_order").collect()] == [1, 2, 7, 3]
    even = preprocess.sample_scans(scans, take="even")
    assert [(r.num, r.new_num) for r in even.collect()] == [(7, 1)]
    mzxml.write_mzxml(scans.where("scan_type = 'Full'"), str(tmp_path / "one"), one_file=True)
    (part,) = (tmp_path / "one").glob("part-*")
    root = ElementTree.fromstring(part.read_text())
    run = root.find("msRun")
    assert root.tag == "mzXML" and run.attrib == {"scanCount": "3", "startTime": "PT1.5S", "endTime": "PT0M3S"}
    assert [s.get("num") for s in run.findall("scan")] == ["1", "2", "3"] and run.findall("scan")[2].get("filterLine") == 'a & "b"'
    assert run.findall("scan")[2].get("msLevel") == "3" and not run.findall("scan")[2].get("basePeakMz")
    assert list(root.find("indexOffset").attrib.values()) == ["1"] and root.find("index") is None
    assert [p.get("compressedLen") for p in run.iter("peaks")] == ["0", "32", None]
    assert mzxml.read_run(spark, str(tmp_path / "one")).first()[:] == (3, "PT1.5S", "PT0M3S")
    layers = "".join(f'<scan num="{k}" scanType="Full" retentionTime="PT1S"><peaks precision="32"></peaks>' for k in range(8)) + "</scan>" * 8
    (tmp_path / "too_deep.mzXML").write_text(f"<mzXML><msRun>{layers}</msRun></mzXML>")
    with pytest.raises(Exception, match="nested deeper"):
        mzxml.read_scans(spark, str(tmp_path / "too_deep.mzXML")).collect()


def test_profiles_of_abundance_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "GKR", 2), (2, "A", 9)], "seq_id long, sequence string, charge int")
    table = spark.createDataFrame([("C", 1, 0.5, 13.0), ("Xx", 1, 0.1, 5.0)], "element string, mass_offset int, p double, mass double")
    got = isotopes.profiles(rows, mode=1, abundance=table).where("seq_id = 2").orderBy("idx").collect()
    assert [r.pct for r in got][:4] == pytest.approx([12.5, 37.5, 37.5, 12.5]) and got[0].mz == pytest.approx(isotopes.with_mass(isotopes.composition(rows)).where("seq_id = 2").first().mass + 3)
    isotopes.write_profiles(isotopes.profiles(rows, mode=2), rows, str(tmp_path / "print"))
    lines = [x for f in sorted((tmp_path / "print").glob("part-*")) for x in f.read_text().split("\n")[:-1]]
    assert lines[0] == "GKR  2" and "A  1" in lines and lines[-1] == "" and lines.count("") == 2
    assert lines[1].split()[0] == "0" and len(lines) == 4 + sum(r.n for r in isotopes.fast_exchange(isotopes.composition(rows)).groupBy("seq_id").agg(F.count("*").alias("n")).collect())


def test_corrected_clusters_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([(4, 2, 1.5, 20.0, 3.0), (4, 2, 1.5, 9.0, 4.0), (4, 1, 0.5, 30.0, 5.0)], "cluster_id long, scan_ord int, rt double, mz double, corrected double")
    text.write_corrected(df, str(tmp_path / "c"))
    (part,) = (tmp_path / "c" / "cluster_id=4").glob("part-*")
    assert part.read_text().split("\n") == ["1 0.500 30.000 5.000", "2 1.500 9.000 4.000", "2 1.500 20.000 3.000", ""]


def test_open_clusters_equal_the_batch_rule():
    rng = random.Random(4)
    points = sorted((rng.randrange(15), round(rng.random() * 3, 2), i) for i in range(200))
    for merges in (None, 1):
        o = OpenClusters(0.2, 2, merges)
        closed = []
        for s, m, i in points:
            o.add(i, s, m)
            closed += o.close()
        closed += o.close(everything=True)
        got = {p[0]: min(q[0] for q in c) for c in closed for p in c}
        colours = clustering.sequential_labels([p[0] for p in points], [p[1] for p in points], 0.2, 2, merges)
        least = {}
        for c, p in zip(colours, points, strict=True):
            least[c] = min(p[2], least.get(c, p[2]))
        assert got == {p[2]: least[c] for c, p in zip(colours, points, strict=True)}
        assert not o.members and not o.rule.root and not o.rule.scans


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, s, round(rng.random() * 2, 2), 0) for i, s in enumerate(sorted(rng.randrange(30) for _ in range(150)))]
    schema = "peak_id long, scan_ord int, mz double, slab int, at timestamp"
    stamped = [(*r, datetime.fromtimestamp(1_700_000_000 + r[1], timezone.utc)) for r in rows]
    parts = [stamped[:60], stamped[60:], [(-1, 10_000, 0.0, 9, datetime.fromtimestamp(1_700_100_000, timezone.utc))], [(-2, 20_000, 0.0, 9, datetime.fromtimestamp(1_700_200_000, timezone.utc))]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in*"))
    q = cluster_stream(stream, 0.1, min_size=3).writeStream.format("memory").queryName("stream_clusters").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.peak_id: r.cluster_id for r in spark.table("stream_clusters").collect() if r.peak_id >= 0}
    batch = clustering.cluster(spark.createDataFrame([r[:3] for r in rows], "peak_id long, scan_ord int, mz double"), 0.1, 2, 3)
    assert got == {r.peak_id: r.cluster_id for r in batch.collect()}
