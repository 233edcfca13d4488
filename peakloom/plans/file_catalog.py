"""Registered queries that write files or streams and read them back, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from peakloom.functions.scalars import duration_seconds
from peakloom.functions.shared import run_dir, written
from peakloom.operators import asof, clustering, deadtime, grid, growing, isotopes, preprocess
from peakloom.plans.catalog import _CLUSTERS, _HOURS, _LABELS, _P, _SEQ, GRID_GAP, GRID_MIN, MIN_SIZE, MZ_DIST, TAU_NE, A, N, _by_time, _clustered, _isotopic, _peaks, _points, _rounded, query
from peakloom.sources import adapters, mzxml, mzxml_rewrite
from peakloom.sources import text as text_files
from peakloom.streaming.clusterer import link_stream, resolved

#: Slabs of the stream's mz.
STREAM_SLABS = 12
#: Points of a stretch of the stream in the mean, which is one micro-batch; there are three at least.
STRETCH_POINTS = 4_000_000

# --- mzXML ----------------------------------------------------------------------------------


def _document(spark: SparkSession, d: str) -> str:
    """A document of all peaks, its scans numbered from 1 and with their mz range as attributes."""
    path = run_dir(spark, "mzxml")
    peaks = _peaks(spark, d)
    span = peaks.groupBy(F.col("scan_num").alias("num")).agg(F.min("mz").cast("string").alias("lowMz"), F.max("mz").cast("string").alias("highMz"))
    known = [F.col(a) if a in ("lowMz", "highMz") else F.lit(None).cast("string").alias(a) for a in mzxml.CARRIED]
    scans = mzxml.encode_scans(peaks, 64, "zlib").join(span, "num").withColumn("attributes", F.struct(*known))
    mzxml.write_mzxml(scans, path)
    return path


@query(f"WITH {_P} SELECT scan_num + 1 AS scan_num, rt, mz, intensity FROM p")
def mzxml_round_trip(spark, d):
    scans = mzxml.read_scans(spark, _document(spark, d)).withColumn("rt", duration_seconds(F.col("rt_text")))
    return mzxml.explode_peaks(mzxml.decode_scans(scans)).select("scan_num", "rt", "mz", "intensity")


@query(f"WITH {_P} SELECT scan_num + 1 AS scan_num, rt, mz, intensity FROM p WHERE rt BETWEEN 1e7 AND 5e7 AND mz > 300 AND mz < 400")
def mzxml_filtered(spark, d):
    scans = preprocess.sample_scans(mzxml.read_scans(spark, _document(spark, d)), "Full", rt=(1e7, 5e7), renumber=False)
    peaks = mzxml.explode_peaks(mzxml.decode_scans(scans.drop("new_num")))
    return preprocess.filter_peaks(peaks, 300.0, 400.0).select("scan_num", "rt", "mz", "intensity")


@query(f"WITH {_P} SELECT scan_num + 1 AS scan_num, rt, mz, intensity FROM p WHERE rt BETWEEN 1e7 AND 5e7 AND scan_num < 2000")
def mzxml_source_filtered(spark, d):
    scans = mzxml_rewrite.read(spark, _document(spark, d)).where("scan_type = 'Full' AND rt BETWEEN 1e7 AND 5e7 AND num <= 2000")
    return mzxml.explode_peaks(mzxml.decode_scans(scans)).select("scan_num", "rt", "mz", "intensity")


_REWRITTEN = f"WITH {_P}, o AS (SELECT *, dense_rank() OVER (ORDER BY scan_num) AS place FROM p), k AS (SELECT *, dense_rank() OVER (ORDER BY scan_num) AS num FROM o WHERE place % 2 = 0 AND rt BETWEEN 1e7 AND 5e7) "


def _rewritten(spark: SparkSession, d: str) -> str:
    path = run_dir(spark, "mzxml-rewritten")
    mzxml_rewrite.rewrite(spark, _document(spark, d), path, take="even", rt=(1e7, 5e7), mz=(200.0, 700.0), min_intensity=10.0)
    return path


@query(_REWRITTEN + "SELECT num::INT AS scan_num, rt, mz, intensity FROM k WHERE mz > 200 AND mz < 700 AND intensity > 10")
def mzxml_rewritten(spark, d):
    scans = mzxml_rewrite.read(spark, _rewritten(spark, d))
    return mzxml.explode_peaks(mzxml.decode_scans(scans)).select("scan_num", "rt", "mz", "intensity")


@query(_REWRITTEN + ", s AS (SELECT num, rt, min(mz) AS low_mz, count(*) FILTER (WHERE mz > 200 AND mz < 700 AND intensity > 10) AS n FROM k GROUP BY 1, 2) SELECT num::INT AS num, rt, low_mz, n::INT AS peaks_count FROM s WHERE num IN (2, 30, 31, 100, 400)")
def mzxml_looked_up(spark, d):
    path = _rewritten(spark, d)
    mzxml_rewrite.add_index(spark, path)
    scans = mzxml_rewrite.read(spark, path).where(F.col("num").isin(2, 30, 31, 100, 400))
    return scans.select("num", "rt", F.col("attributes")["lowMz"].cast("double").alias("low_mz"), "peaks_count")


@query(f"WITH {_P}, s AS (SELECT scan_num, count(*) AS n FROM p GROUP BY 1), o AS (SELECT scan_num, n, row_number() OVER (ORDER BY scan_num) AS place FROM s) SELECT scan_num + 1 AS num, n::INT AS peaks_count, (row_number() OVER (ORDER BY scan_num))::INT AS new_num FROM o WHERE place % 2 = 0")
def mzxml_even_scans(spark, d):
    return preprocess.sample_scans(mzxml.read_scans(spark, _document(spark, d)), "Full", "even").select("num", "peaks_count", "new_num")


@query(f"WITH {_P} SELECT scan_num + 1 AS num, min(mz) AS low_mz, max(mz) AS high_mz FROM p GROUP BY 1")
def mzxml_attributes(spark, d):
    scans = mzxml.read_scans(spark, _document(spark, d))
    return scans.select("num", F.col("attributes.lowMz").cast("double").alias("low_mz"), F.col("attributes.highMz").cast("double").alias("high_mz"))


@query(f"WITH {_P} SELECT count(DISTINCT scan_num) AS scan_count, printf('PT%.6fS', min(rt)) AS start_time, printf('PT%.6fS', max(rt)) AS end_time FROM p")
def mzxml_run_header(spark, d):
    return mzxml.read_run(spark, _document(spark, d))


# --- text -----------------------------------------------------------------------------------


@query(f"WITH {_P} SELECT scan_num, rt, round(mz * 10, 3) AS mz, intensity FROM p")
def peak_text_round_trip(spark, d):
    path = run_dir(spark, "peaks")
    text_files.write_peaks(_peaks(spark, d).withColumn("mz", F.col("mz") * 10), path)  # three decimals, so no ties
    return text_files.read_peaks(spark, path)


def _stretches(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of 50 scans as clusters, with mz of three decimals."""
    return _peaks(spark, d).select(F.floor(F.col("scan_num") / 50).cast("bigint").alias("cluster_id"), F.col("scan_num").alias("scan_ord"), "rt", (F.col("mz") * 10).alias("mz"), "intensity")


_FILED = f"WITH {_P} SELECT (scan_num // 50)::INT AS cluster_id, scan_num AS scan_ord, rt, round(mz * 10, 3) AS mz, intensity FROM p"


@query(_FILED)
def cluster_files(spark, d):
    path = run_dir(spark, "clust")
    text_files.write_cluster_files(_stretches(spark, d), path)
    return text_files.read_clusters(spark, path)


@query(_FILED)
def cluster_files_strict(spark, d):
    path = run_dir(spark, "clust")
    text_files.write_cluster_files(_stretches(spark, d), f"{path}/deep/er")
    return text_files.read_clusters(spark, path, strict=True, recursive=True)


@query(_FILED)
def cluster_files_of_globs(spark, d):
    path, points = run_dir(spark, "clust"), _stretches(spark, d)
    for k in range(2):
        text_files.write_cluster_files(points.where(F.col("cluster_id") % 2 == k), f"{path}/part{k}")
    return text_files.read_clusters(spark, [f"{path}/part{k}/*.clust" for k in range(2)])


@query(f"WITH {_P} SELECT (scan_num // 50)::BIGINT AS cluster_id, count(*) AS n_points FROM p GROUP BY 1")
def cluster_folders(spark, d):
    path = run_dir(spark, "clust")
    text_files.write_clusters(_stretches(spark, d), path)
    return spark.read.text(path).groupBy(F.col("cluster_id").cast("bigint").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n_points"))


_LISTED = "SELECT s_suppkey, printf('clust/%06d.clust', s_suppkey) AS path, s_name FROM supplier"


def _list(spark: SparkSession, d: str) -> str:
    path = run_dir(spark, "list")
    rows = adapters.table(spark, d, "supplier")
    rows.select(F.format_string("clust/%06d.clust %s ", F.col("s_suppkey").cast("bigint"), "s_name").alias("value")).write.text(path)
    return path


@query(f"SELECT path FROM ({_LISTED})")
def file_list(spark, d):
    return text_files.read_file_list(spark, _list(spark, d))


@query(f"SELECT unnest([path, s_name]) AS path FROM ({_LISTED})")
def file_list_all(spark, d):
    return text_files.read_file_list(spark, _list(spark, d), first_only=False)


@query(f"SELECT path FROM ({_LISTED}) WHERE s_suppkey % 3 = 0")
def existing_clusters(spark, d):
    every = text_files.read_file_list(spark, _list(spark, d), first_only=False)
    third = adapters.table(spark, d, "supplier").where("s_suppkey % 3 = 0")
    found = third.select(F.format_string("clust/%06d.clust", F.col("s_suppkey").cast("bigint")).alias("path")).union(third.select("s_name"))
    return text_files.existing_clusters(every, found)


@query("SELECT regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS sequence, (CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE p_partkey % 9 END)::INT AS charge FROM part")
def sequence_file(spark, d):
    path = run_dir(spark, "sequences")
    rows = adapters.part_sequences(spark, d).withColumn("charge", F.col("seq_id") % 9)
    rows.select(F.when(F.col("charge") == 0, F.col("sequence")).otherwise(F.format_string("%s %d", "sequence", "charge")).alias("value")).write.text(path)
    return text_files.read_sequences(spark, path).select("sequence", "charge")


#: An abundance table: element, offset, probability, mass.
_ABUNDANCES = (("H", 1, 0.0002, 1.008), ("C", 0, 0.98, 12.0), ("C", 1, 0.02, 12.0), ("N", 1, 0.004, 14.003), ("O", 2, 0.003, 15.995), ("S", 1, 0.01, 31.972), ("S", 2, 0.05, 31.972))
_OWN = tuple((e.lower(), k, p) for e, k, p, _ in _ABUNDANCES if k)
_OWN_MASSES = {e.lower(): m for e, _, _, m in _ABUNDANCES}


@query(f"WITH {_isotopic(_OWN)}, top AS (SELECT seq_id, max(pct) AS top FROM (SELECT *, max(idx) OVER (PARTITION BY seq_id) AS last FROM iso) WHERE idx < last OR last = 0 GROUP BY 1) SELECT seq_id, idx::INT AS idx, round({' + '.join(f'a.{x} * {m}' for x, m in _OWN_MASSES.items())} + idx * {isotopes.SPACING}, 6) AS mz, round(pct, 6) AS pct, round(pct / top * 100, 6) AS pct_norm FROM iso JOIN top USING (seq_id) JOIN a USING (seq_id)")
def abundance_profile(spark, d):
    path = run_dir(spark, "abundances")
    spark.createDataFrame([(f"{e} {k} {p} {m}",) for e, k, p, m in _ABUNDANCES], "value string").write.text(path)
    return _rounded(isotopes.profiles(adapters.part_sequences(spark, d), mode=1, abundance=text_files.read_abundances(spark, path)), "mz", "pct", "pct_norm")


_PRINTED = "fast AS (SELECT seq_id, sequence, k, exp(lgamma(deut + 1) - lgamma(k + 1) - lgamma(deut - k + 1)) * pow(0.05, k) * pow(0.95, deut - k) * 100 AS q, " + " + ".join(f"{x} * {m}" for x, m in isotopes.MASSES.items()) + f" + k * {isotopes.SPACING} AS mz FROM (SELECT *, unnest(range(deut + 1)) AS k FROM a))"


@query(f"WITH {_SEQ}, {_PRINTED} SELECT seq_id, k::INT AS place, printf('%d %10.4f %5.2f  %5.2f', k, mz + 1e-7, q + 1e-7, q / max(q) OVER (PARTITION BY seq_id) * 100 + 1e-7) AS value FROM fast UNION ALL SELECT seq_id, -1, sequence || '  1' FROM a UNION ALL SELECT seq_id, 2147483647, '' FROM a")
def profile_print(spark, d):
    sequences = adapters.part_sequences(spark, d)
    rows = isotopes.profiles(sequences, mode=2).withColumns({c: F.col(c) + 1e-7 for c in ("mz", "pct", "pct_norm")})  # off decimal ties
    return isotopes.profile_lines(rows, sequences)


@query(f"WITH {_P}, b AS (SELECT peak_id, mz, floor((sqrt(mz) - 3.0) / {(math.sqrt(1000.0) - 3.0) / 8!r}::DOUBLE)::INT + 1 AS block FROM p WHERE mz > 9 AND mz < 1000), g AS (SELECT *, pow(3.0 + (block - 1) * {(math.sqrt(1000.0) - 3.0) / 8!r}::DOUBLE, 2) AS lo, pow(3.0 + block * {(math.sqrt(1000.0) - 3.0) / 8!r}::DOUBLE, 2) AS hi FROM b) SELECT peak_id, mz, block FROM g WHERE mz > lo AND mz < hi")
def block_files(spark, d):
    path = run_dir(spark, "blocks")
    text_files.write_blocks(grid.mz_blocks(_peaks(spark, d), 9.0, 1000.0, 8).select("peak_id", "mz", "block"), path)
    return spark.read.parquet(path).select("peak_id", "mz", F.col("block").cast("int").alias("block"))


@query(f"WITH {_P} SELECT count(*) AS n_peaks FROM p WHERE intensity >= 5")
def null_sink(spark, d):
    seen = Observation()
    text_files.discard(_peaks(spark, d).where("intensity >= 5").observe(seen, F.count(F.lit(1)).alias("n")))
    return spark.range(1).select(F.lit(seen.get["n"]).cast("bigint").alias("n_peaks"))


@query(f"""WITH {_P}, t AS (SELECT *, {A!r}::DOUBLE * sqrt(mz) AS t FROM p),
x AS (SELECT scan_num, rt, mz, 1 - intensity / ({N!r}::DOUBLE - (sum(intensity) OVER (PARTITION BY scan_num ORDER BY t RANGE BETWEEN {TAU_NE!r}::DOUBLE PRECEDING AND CURRENT ROW) - sum(intensity) OVER (PARTITION BY scan_num ORDER BY t RANGE BETWEEN CURRENT ROW AND CURRENT ROW))) AS x FROM t),
c AS (SELECT scan_num // 50 AS cluster_id, scan_num, rt, mz * 10 AS mz, -{N!r}::DOUBLE * ln(x) AS i FROM x WHERE x > 0)
SELECT cluster_id::BIGINT AS cluster_id, (row_number() OVER (PARTITION BY cluster_id ORDER BY rt, mz, i))::INT AS place, printf('%s %.3f %.3f %.3f', scan_num::VARCHAR, rt, mz, i) AS value FROM c""")
def corrected_text(spark, d):
    fixed = deadtime.correct_nonextending(_peaks(spark, d), TAU_NE).where("corrected is not null")
    points = fixed.select(F.floor(F.col("scan_num") / 50).cast("bigint").alias("cluster_id"), F.col("scan_num").alias("scan_ord"), "rt", (F.col("mz") * 10).alias("mz"), "corrected")
    return text_files.corrected_lines(points)


@query(f"WITH RECURSIVE {_LABELS}, f AS (SELECT *, printf('%.3f', mz * 10) AS t FROM k), n AS (SELECT *, coalesce(mz <> lag(mz) OVER w, true)::INT AS c FROM f WINDOW w AS (PARTITION BY cluster_id ORDER BY t, rt, mz, peak_id)) SELECT cluster_id, peak_id, sum(c) OVER (PARTITION BY cluster_id ORDER BY t, rt, mz, peak_id ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM n")
def plot_lines_by_text(spark, d):
    return text_files.plot_table(_clustered(spark, d).withColumn("mz", F.col("mz") * 10), by_text=True).select("cluster_id", "peak_id", "line")


# --- order and bounds -----------------------------------------------------------------------


@query(f"WITH {_P}, x AS (SELECT peak_id, coalesce(rt <> lag(rt) OVER (ORDER BY peak_id), false)::INT AS new FROM p) SELECT peak_id, (sum(new) OVER (ORDER BY peak_id ROWS UNBOUNDED PRECEDING))::INT AS scan_ord FROM x")
def scan_run_ordinals(spark, d):
    return clustering.with_run_ordinals(_peaks(spark, d), "peak_id").select("peak_id", "scan_ord")


_BINS = 100


@query(f"""WITH RECURSIVE {_P}, g AS (SELECT range AS c, pow({math.sqrt(GRID_MIN)!r} + range * {GRID_GAP}, 2) AS mz FROM range({_BINS + 1})),
q AS (SELECT scan_num, peak_id, p.mz, (SELECT count(*) FROM g WHERE g.mz <= p.mz - 3.0) AS low FROM p WHERE p.mz >= {GRID_MIN} - 3.0 AND p.mz <= (SELECT max(mz) FROM g) + 3.0),
s AS MATERIALIZED (SELECT scan_num, list(peak_id ORDER BY mz, peak_id) AS ids, list(mz ORDER BY mz, peak_id) AS ms, list(low ORDER BY mz, peak_id) AS lows FROM q GROUP BY 1),
r AS (SELECT *, 0 AS k, 0::BIGINT AS free, []::BIGINT[] AS bins FROM s UNION ALL SELECT scan_num, ids, ms, lows, k + 1, CASE WHEN ok THEN c + 1 ELSE free END, list_append(bins, CASE WHEN ok THEN c END)
  FROM (SELECT *, c < {_BINS} AND pow({math.sqrt(GRID_MIN)!r} + c * {GRID_GAP}, 2) - ms[k + 1] < 3.0 AS ok FROM (SELECT *, greatest(free, lows[k + 1]) AS c FROM r WHERE k < len(ms)))),
u AS (SELECT scan_num, unnest(ids) AS peak_id, unnest(bins) AS bin FROM r WHERE k = len(ms))
SELECT scan_num, peak_id, bin::INT AS bin FROM u WHERE bin IS NOT NULL""")
def grid_matches_in_order(spark, d):
    return grid.grid_matches_in_order(_peaks(spark, d).select("scan_num", "peak_id", "mz"), GRID_MIN, GRID_GAP, _BINS, 3.0).select("scan_num", "peak_id", "bin")


_MARKS = "g AS (SELECT DISTINCT h * 3600.0 + 1800 AS rt, h AS grid FROM ev)"


@query(f"WITH {_HOURS}, {_MARKS}, e AS (SELECT peak_id, h * 3600.0 + CASE WHEN peak_id % 3 = 0 THEN 1800 ELSE peak_id % 3600 END AS rt FROM ev) SELECT e.peak_id, le.grid AS at_or_below, lt.grid AS below, ge.grid AS at_or_above, gt.grid AS above, eq.grid AS equal FROM e ASOF LEFT JOIN g le ON e.rt >= le.rt ASOF LEFT JOIN g lt ON e.rt > lt.rt ASOF LEFT JOIN g ge ON e.rt <= ge.rt ASOF LEFT JOIN g gt ON e.rt < gt.rt LEFT JOIN g eq ON e.rt = eq.rt")
def asof_modes(spark, d):
    rows = adapters.event_points(spark, d)
    marks = rows.select((F.col("scan_num") * 3600.0 + 1800).alias("rt"), F.col("scan_num").alias("grid")).distinct()
    out = rows.select("peak_id", (F.col("scan_num") * 3600.0 + F.when(F.col("peak_id") % 3 == 0, 1800).otherwise(F.col("peak_id") % 3600)).alias("rt"))
    for mode, name in (("<=", "at_or_below"), ("<", "below"), (">=", "at_or_above"), (">", "above"), ("=", "equal")):
        out = asof.asof(out, marks, "rt", "grid", mode, out=name)
    return out.drop("rt")


@query("SELECT o_orderkey, CASE WHEN p > 99.9 OR p < 0 THEN 5.0 ELSE p END AS percent, (CASE WHEN z < 1 OR z > 7 THEN 1 ELSE z END)::INT AS charge FROM (SELECT o_orderkey, (o_orderkey % 1200) / 10.0 - 10 AS p, o_orderkey % 10 AS z FROM orders)")
def clamped_parameters(spark, d):
    rows = adapters.table(spark, d, "orders")
    percent, charge = (F.col("o_orderkey") % 1200) / 10.0 - 10, (F.col("o_orderkey") % 10).cast("int")
    return rows.select("o_orderkey", isotopes.clamp_percent(percent).cast("double").alias("percent"), isotopes.clamp_charge(charge).cast("int").alias("charge"))


# --- the stream -----------------------------------------------------------------------------


@query(f"WITH RECURSIVE {_LABELS} SELECT peak_id, scan_ord, mz, cluster_id FROM k")
def clusters_grown(spark, d):
    """Clusters of three growths, each of a third of the scans."""
    points = _points(spark, d).select("peak_id", "scan_ord", "mz")
    third = (points.agg(F.max("scan_ord")).first()[0] or 0) // 3 + 1
    table = growing.Clusters(spark, run_dir(spark, "growing"), MZ_DIST)
    for k in range(3):
        table.grow(points.where(F.floor(F.col("scan_ord") / third) == k))
    return table.clusters(MIN_SIZE).select("peak_id", "scan_ord", "mz", "cluster_id")


@query(f"WITH RECURSIVE {_LABELS} SELECT cluster_id, peak_id, scan_ord::BIGINT AS scan_ord, mz FROM k")
def stream_clusters(spark, d):
    """Points as files of a stream in retention-time order, in slabs of mz; members and merges go out early and are resolved at the end."""
    folder, files = run_dir(spark, "stream"), 4
    points = _points(spark, d).select("peak_id", F.col("scan_ord").cast("long").alias("scan_ord"), "mz", F.timestamp_seconds(F.col("scan_ord") + 1_000_000_000).alias("at"))
    points = written(points.repartitionByRange("scan_ord"), "stream-points")
    ends = points.agg(F.max("scan_ord"), F.min("mz"), F.max("mz"), F.count(F.lit(1))).first()
    stretches = max(3, -(-ends[3] // STRETCH_POINTS))
    step = (ends[0] or 0) // stretches + 1
    for k in range(stretches):
        points.where(F.col("scan_ord").between(k * step, (k + 1) * step - 1)).repartition(files).write.parquet(f"{folder}/in/{k:06d}")
    width = max(4 * MZ_DIST, ((ends[2] or 0.0) - (ends[1] or 0.0)) / STREAM_SLABS)
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    links = link_stream(stream, MZ_DIST, width=width)
    links.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return resolved(spark.read.schema(links.schema).parquet(f"{folder}/out"), MIN_SIZE)
