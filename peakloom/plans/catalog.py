"""Registered queries of the peak engine and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions import sql
from peakloom.functions.scalars import duration_seconds, int_abs, lenient_double, lenient_int
from peakloom.operators import anneal, asof, clustering, curvature, deadtime, grid, isotopes, preprocess, shapes
from peakloom.sources import adapters, mzxml
from peakloom.sources import text as text_files

Query = Callable[[SparkSession, str], DataFrame]
#: Parameters for the driver's tables, whose peaks lie far wider apart than real ones.
MZ_DIST, MIN_SIZE, TAU_NE, TAU_E, BLOCKS = 2.0, 3, 2e-6, 5e-7, 8
N, A = deadtime.pulses(), deadtime.flight_constant()
GRID_MIN, GRID_GAP = 1.0, 0.25
_REGISTRY: dict[str, tuple[Query, str | None]] = {}

_P = """p AS (SELECT ('0x' || substr(md5(concat_ws('|', l_orderkey::BIGINT, l_linenumber::BIGINT, l_partkey::BIGINT, l_suppkey::BIGINT)), 1, 15))::BIGINT AS peak_id, (dense_rank() OVER (ORDER BY l_shipdate) - 1)::INT AS scan_num,
  (epoch(l_shipdate::TIMESTAMP) - min(epoch(l_shipdate::TIMESTAMP)) OVER ())::DOUBLE AS rt, l_extendedprice::DOUBLE / 100 AS mz, l_quantity::DOUBLE AS intensity, l_returnflag AS scan_type FROM lineitem)"""


def query(text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _REGISTRY[f.__name__] = (f, text)
        return f

    return add


def _peaks(spark: SparkSession, d: str) -> DataFrame:
    return adapters.lineitem_peaks(spark, d)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- filters, sampling, numbering -----------------------------------------------------------


@query(f"WITH {_P} SELECT peak_id, scan_num, rt, mz, intensity FROM p WHERE intensity > 0 AND mz > 100 AND mz < 900 AND intensity >= 5")
def peak_filter(spark, d):
    return preprocess.filter_peaks(_peaks(spark, d), 100.0, 900.0, 0.0, 5.0).select("peak_id", "scan_num", "rt", "mz", "intensity")


def _scans(spark: SparkSession, d: str) -> DataFrame:
    """A scan for each date and return flag, the flag being its type."""
    return _peaks(spark, d).groupBy(F.col("scan_num").alias("num"), "scan_type").agg(F.min("rt").alias("rt"), F.count(F.lit(1)).alias("peaks_count"))


_SCANS = f"{_P}, s AS (SELECT scan_num AS num, scan_type, min(rt) AS rt, count(*) AS peaks_count FROM p GROUP BY ALL)"


@query(f"WITH {_SCANS}, o AS (SELECT *, row_number() OVER (ORDER BY num) AS place FROM s WHERE scan_type = 'N') SELECT num, rt, peaks_count, (row_number() OVER (ORDER BY num))::INT AS new_num FROM o WHERE place % 2 = 0 AND rt BETWEEN 1e7 AND 2e8")
def scan_sample_even(spark, d):
    return preprocess.sample_scans(_scans(spark, d), "N", "even", (1e7, 2e8)).select("num", "rt", "peaks_count", "new_num")


@query(f"WITH {_SCANS}, o AS (SELECT *, row_number() OVER (ORDER BY num) AS place FROM s WHERE scan_type = 'R') SELECT num, rt, peaks_count, num AS new_num FROM o WHERE place % 2 = 1 AND num BETWEEN 100 AND 1500")
def scan_sample_odd(spark, d):
    return preprocess.sample_scans(_scans(spark, d), "R", "odd", num=(100, 1500), renumber=False).select("num", "rt", "peaks_count", "new_num")


@query(f"WITH {_SCANS} SELECT num, rt, (row_number() OVER (ORDER BY num))::INT AS new_num FROM s WHERE scan_type = 'A'")
def scan_renumber(spark, d):
    return preprocess.sample_scans(_scans(spark, d), "A").select("num", "rt", "new_num")


@query(f"WITH {_P} SELECT scan_num, count(*) AS n_peaks, min(rt) AS rt, min(mz) AS low_mz, max(mz) AS high_mz, max(intensity) AS base_intensity, arg_max(mz, struct_pack(a := intensity, b := -mz)) AS base_mz FROM p GROUP BY scan_num")
def scan_summary(spark, d):
    return preprocess.scan_summary(_peaks(spark, d))


@query(f"WITH {_SCANS} SELECT count(*) AS scan_count, 'PT' || min(rt)::BIGINT || 'S' AS start_time, 'PT' || max(rt)::BIGINT || 'S' AS end_time FROM s WHERE scan_type = 'N'")
def run_header(spark, d):
    scans = _scans(spark, d).where("scan_type = 'N'").withColumn("rt_text", F.concat(F.lit("PT"), F.col("rt").cast("bigint").cast("string"), F.lit("S")))
    return preprocess.run_header(scans)


@query(f"WITH {_P} SELECT scan_num, count(*) AS n_peaks FROM p GROUP BY scan_num ORDER BY n_peaks DESC, scan_num LIMIT 1")
def fullest_scan(spark, d):
    return preprocess.fullest_scan(_peaks(spark, d))


@query(f"WITH {_P} SELECT min(mz) AS low_mz, max(mz) AS high_mz, count(*) AS n_peaks, count(DISTINCT scan_num) AS n_scans FROM p")
def mz_range(spark, d):
    return _peaks(spark, d).agg(F.min("mz").alias("low_mz"), F.max("mz").alias("high_mz"), F.count(F.lit(1)).alias("n_peaks"), F.countDistinct("scan_num").alias("n_scans"))


_SIDES = "lag(intensity) OVER w AS l, lead(intensity) OVER w AS r"


@query(f"WITH {_P}, x AS (SELECT *, {_SIDES} FROM p WINDOW w AS (PARTITION BY scan_num ORDER BY mz, peak_id)) SELECT peak_id, scan_num, mz, intensity FROM x WHERE NOT (coalesce(intensity < l, false) OR coalesce(intensity < r, false))")
def local_maxima(spark, d):
    return preprocess.local_maxima(_peaks(spark, d)).select("peak_id", "scan_num", "mz", "intensity")


@query(f"WITH e AS (SELECT vec_id AS scan_num, (unnest(range(len(embedding))))::DOUBLE AS mz, unnest(embedding)::DOUBLE AS intensity FROM embeddings), x AS (SELECT *, {_SIDES} FROM e WINDOW w AS (PARTITION BY scan_num ORDER BY mz)) SELECT scan_num, mz, intensity FROM x WHERE NOT (coalesce(intensity < l, false) OR coalesce(intensity < r, false))")
def local_maxima_embeddings(spark, d):
    return preprocess.local_maxima(adapters.embedding_peaks(spark, d))


_SORTED = "list_transform(list_sort(list_transform({}, lambda x, p: struct_pack(k := -x.i, p := p, v := x))), lambda y: y.v)"


@query(f"""WITH RECURSIVE {_P}, x AS (SELECT *, {_SIDES} FROM p WINDOW w AS (PARTITION BY scan_num ORDER BY mz, peak_id)),
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY scan_num, mz, peak_id) AS pos, struct_pack(i := intensity, s := scan_num, m := mz) AS cand FROM x WHERE NOT (coalesce(intensity < l, false) OR coalesce(intensity < r, false))),
r AS (SELECT 0::BIGINT AS pos, []::STRUCT(i DOUBLE, s INTEGER, m DOUBLE)[] AS best UNION ALL
  SELECT pos, CASE WHEN len(best) = 10 AND cand.i < best[10].i THEN best WHEN hit IS NULL THEN {_SORTED.format('list_append(best[1:9], cand)')} WHEN best[hit].i < cand.i THEN {_SORTED.format('list_transform(best, lambda z, q: CASE WHEN q = hit THEN cand ELSE z END)')} ELSE best END
  FROM (SELECT c.pos, cand, best, nullif(list_position(list_transform(best, lambda z: abs(z.s - cand.s) < 20 AND abs(z.m - cand.m) < 0.05), true), 0) AS hit FROM r JOIN c ON c.pos = r.pos + 1)),
f AS (SELECT best FROM r ORDER BY pos DESC LIMIT 1)
SELECT place::INT AS place, best[place].s AS scan_num, best[place].m AS mz, best[place].i AS intensity FROM (SELECT best, unnest(range(1, len(best) + 1)) AS place FROM f)""")
def top_n_suppressed(spark, d):
    return preprocess.highest_peaks(_peaks(spark, d), n=10, scans=20, mz=0.05)


_CLUSTERS = f"{_P}, c AS (SELECT scan_num // 50 AS cluster_id, rt, mz, intensity, peak_id FROM p)"


def _by_time(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of 50 scans as clusters, for operators that take clusters as given."""
    return _peaks(spark, d).select(F.floor(F.col("scan_num") / 50).cast("bigint").alias("cluster_id"), "rt", "mz", "intensity", "peak_id")


@query(f"WITH {_CLUSTERS}, s AS (SELECT cluster_id, rt FROM c GROUP BY ALL HAVING count(*) >= 20 AND max(intensity) >= 40), k AS (SELECT cluster_id FROM s GROUP BY 1 HAVING count(*) >= 20) SELECT cluster_id::BIGINT AS cluster_id, rt, mz, intensity, peak_id FROM c SEMI JOIN (SELECT s.* FROM s SEMI JOIN k USING (cluster_id)) USING (cluster_id, rt)")
def bright_clusters(spark, d):
    return preprocess.bright_clusters(_by_time(spark, d), 20, 40.0, 20).select("cluster_id", "rt", "mz", "intensity", "peak_id")


# --- deadtime -------------------------------------------------------------------------------


@query(f"""WITH {_P}, t AS (SELECT *, {A!r}::DOUBLE * sqrt(mz) AS t FROM p),
x AS (SELECT peak_id, scan_num, mz, intensity, 1 - intensity / ({N!r}::DOUBLE - (sum(intensity) OVER (PARTITION BY scan_num ORDER BY t RANGE BETWEEN {TAU_NE!r}::DOUBLE PRECEDING AND CURRENT ROW) - sum(intensity) OVER (PARTITION BY scan_num ORDER BY t RANGE BETWEEN CURRENT ROW AND CURRENT ROW))) AS x FROM t)
SELECT peak_id, scan_num, mz, intensity, round(CASE WHEN x > 0 THEN -{N!r}::DOUBLE * ln(x) END, 6) AS corrected FROM x""")
def deadtime_nonext(spark, d):
    fixed = deadtime.correct_nonextending(_peaks(spark, d), TAU_NE)
    return _rounded(fixed.select("peak_id", "scan_num", "mz", "intensity", "corrected"), "corrected")


def _recurrence(groups: str, keys: str) -> str:
    """CTEs r(keys, ms, xs, outs): corrected intensities of every group's peaks, one after the other; NaN where saturated. ``groups`` has keys, mz and intensity."""
    i, window = "k + 1", f"ts[k + 1] - ts[j] <= {TAU_NE!r}"
    total = lambda what, when: f"coalesce(list_sum(list_transform(range(1, {i}), lambda j: CASE WHEN {window} AND {when} THEN {what} ELSE 0 END)), 0)"
    free = f"({N!r}::DOUBLE - {total('xs[j]', f'ts[k + 1] - ts[j] > {TAU_E!r}')})"
    x = f"1 - xs[{i}] * exp({total('outs[j]', f'ts[k + 1] - ts[j] <= {TAU_E!r}')} / {N!r}::DOUBLE) / {free}"
    return f"""s AS MATERIALIZED (SELECT {keys}, list(mz ORDER BY mz, intensity) AS ms, list(intensity ORDER BY mz, intensity) AS xs, list({A!r}::DOUBLE * sqrt(mz) ORDER BY mz, intensity) AS ts FROM {groups} GROUP BY {keys}),
r AS (SELECT *, 0 AS k, []::DOUBLE[] AS outs FROM s UNION ALL SELECT * EXCLUDE (k, outs, x), k + 1, list_append(outs, CASE WHEN x > 0 AND NOT isnan(x) THEN -{N!r}::DOUBLE * ln(x) ELSE 'nan'::DOUBLE END) FROM (SELECT *, {x} AS x FROM r WHERE k < len(ts)))"""


@query(f"""WITH RECURSIVE {_P}, m AS (SELECT scan_num, mz, sum(intensity) AS intensity FROM p GROUP BY scan_num, mz), {_recurrence('m', 'scan_num')},
u AS (SELECT scan_num, unnest(ms) AS mz, unnest(xs) AS intensity, unnest(outs) AS y FROM r WHERE k = len(ts))
SELECT scan_num, mz, intensity, CASE WHEN NOT isnan(y) THEN round(y, 6) END AS corrected FROM u""")
def deadtime_extending(spark, d):
    return _rounded(deadtime.correct(deadtime.merge_duplicates(_peaks(spark, d)), TAU_NE, TAU_E), "corrected")


@query(f"""WITH RECURSIVE {_CLUSTERS}, {_recurrence('c', 'cluster_id, rt')},
u AS (SELECT cluster_id, rt, unnest(ms) AS mz, unnest(xs) AS intensity, unnest(outs) AS y FROM r WHERE k = len(ts))
SELECT cluster_id::BIGINT AS cluster_id, rt, mz, intensity, round(CASE WHEN bool_or(isnan(y)) OVER (PARTITION BY cluster_id) THEN intensity ELSE y END, 6) AS corrected FROM u""")
def deadtime_clusters(spark, d):
    return _rounded(deadtime.correct_clusters(_by_time(spark, d), TAU_NE, TAU_E), "corrected")


@query(f"WITH {_P} SELECT round({A!r}::DOUBLE * sqrt(max(mz)), 9) AS flight_s, {A!r}::DOUBLE * sqrt(max(mz)) > 45e-6 AS over_cycle FROM p")
def longest_flight(spark, d):
    return deadtime.longest_flight(_peaks(spark, d)).withColumn("flight_s", F.round("flight_s", 9))


# --- traces ---------------------------------------------------------------------------------


@query(f"WITH {_CLUSTERS} SELECT cluster_id::BIGINT AS cluster_id, rt, sum(mz::DECIMAL(12, 4) * intensity::DECIMAL(6, 0))::DOUBLE / sum(intensity::DECIMAL(6, 0))::DOUBLE AS mz, count(*) AS n FROM c GROUP BY cluster_id, rt")
def centroid_per_scan(spark, d):
    return curvature.centroids(_by_time(spark, d).withColumns({"mz": F.col("mz").cast("decimal(12,4)"), "intensity": F.col("intensity").cast("decimal(6,0)")}))


_DAY = 86400.0 * 4000


@query(f"WITH {_CLUSTERS}, m AS (SELECT cluster_id::BIGINT AS cluster_id, rt / {_DAY} AS t, sum(mz * intensity) / sum(intensity) AS mz FROM c GROUP BY cluster_id, rt) SELECT cluster_id, count(*) AS n, {', '.join(f'round(sum(pow(t, {k})), 6) AS t{k}' for k in range(1, 7))}, {', '.join(f'round(sum(pow(t, {k}) * mz), 4) AS m{k}' for k in range(4))} FROM m GROUP BY cluster_id")
def curvature_moments(spark, d):
    sums = curvature.moments(curvature.centroids(_by_time(spark, d)), 3, _DAY)
    return _rounded(sums, *[f"t{k}" for k in range(1, 7)]).withColumns({f"m{k}": F.round(f"m{k}", 4) for k in range(4)})


def _cubic() -> str:
    """CTE v(cluster_id, n, curvature) by the normal equations of a cubic over centred times, solved by elimination; of traces with four times at least."""
    unknowns = range(4)
    steps = [
        f"{_CLUSTERS}, m AS (SELECT cluster_id::BIGINT AS cluster_id, rt, sum(mz * intensity) / sum(intensity) AS mz FROM c GROUP BY cluster_id, rt)",
        "z AS (SELECT *, avg(rt) OVER w AS middle, max(rt) OVER w - min(rt) OVER w AS spread, avg(mz) OVER w AS level FROM m WINDOW w AS (PARTITION BY cluster_id))",
        "y AS MATERIALIZED (SELECT cluster_id, spread, (rt - middle) / spread AS t, mz - level AS h FROM z)",
        f"e0 AS (SELECT cluster_id, count(*) AS n, any_value(spread) AS spread, {', '.join(f'sum(pow(t, {i + j})) AS a{i}{j}' for i in unknowns for j in unknowns)}, {', '.join(f'sum(pow(t, {i}) * h) AS b{i}' for i in unknowns)} FROM y GROUP BY cluster_id)",
    ]
    for k in range(3):
        low = range(k + 1, 4)
        new = [f"a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j} AS a{i}{j}" for i in low for j in low] + [f"b{i} - a{i}{k} / a{k}{k} * b{k} AS b{i}" for i in low]
        steps.append(f"e{k + 1} AS (SELECT * REPLACE ({', '.join(new)}) FROM e{k})")
    steps += ["f3 AS (SELECT *, b3 / a33 AS c3 FROM e3)", "f2 AS (SELECT *, (b2 - a23 * c3) / a22 AS c2 FROM f3)", "f1 AS (SELECT *, (b1 - a12 * c2 - a13 * c3) / a11 AS c1 FROM f2)"]
    first, second = "(c1 + 2 * c2 * t + 3 * c3 * t * t) / y.spread", "(2 * c2 + 6 * c3 * t) / (y.spread * y.spread)"
    steps.append(f"v AS (SELECT cluster_id, any_value(n) AS n, sum({second} / pow(1 + pow({first}, 2), 1.5)) AS curvature FROM y JOIN f1 USING (cluster_id) GROUP BY cluster_id)")
    return ", ".join(steps)


@query(f"WITH {_cubic()} SELECT cluster_id, n, round(curvature, 15) AS curvature FROM v")
def cubic_curvature(spark, d):
    return curvature.cluster_curvature(curvature.centroids(_by_time(spark, d))).withColumn("curvature", F.round("curvature", 15))


@query(f"WITH {_cubic()} SELECT round(sum(abs(curvature)), 14) AS total_curvature FROM v")
def curvature_objective(spark, d):
    return curvature.objective(curvature.centroids(_by_time(spark, d))).withColumn("total_curvature", F.round("total_curvature", 14))


# --- clusters -------------------------------------------------------------------------------


def _points(spark: SparkSession, d: str) -> DataFrame:
    return _peaks(spark, d).where("intensity >= 5").drop("scan_num").transform(clustering.with_scan_ordinals)


_POINTS = f"{_P}, o AS (SELECT peak_id, rt, mz, intensity, (dense_rank() OVER (ORDER BY rt) - 1)::INT AS scan_ord FROM p WHERE intensity >= 5)"
_EDGES = f"{_POINTS}, e AS MATERIALIZED (SELECT x.peak_id AS a, y.peak_id AS b FROM o x JOIN o y ON y.scan_ord IN (x.scan_ord - 1, x.scan_ord - 2) AND y.mz - x.mz BETWEEN -{MZ_DIST} AND {MZ_DIST})"
_LABELS = f"{_EDGES}, sym AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a), lab AS (SELECT a AS peak_id, min(b) AS cluster_id FROM reach GROUP BY a), big AS (SELECT cluster_id FROM lab GROUP BY 1 HAVING count(*) >= {MIN_SIZE}), k AS MATERIALIZED (SELECT o.*, lab.cluster_id FROM o JOIN lab USING (peak_id) SEMI JOIN big USING (cluster_id))"


@query(f"WITH {_EDGES} SELECT a, b FROM e")
def link_edges(spark, d):
    return clustering.link_edges(_points(spark, d), MZ_DIST).select("a", "b")


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    return clustering.cluster(_points(spark, d), MZ_DIST, min_size=MIN_SIZE)


@query(f"WITH RECURSIVE {_LABELS} SELECT peak_id, scan_ord, rt, mz, intensity, cluster_id FROM k")
def cluster_components(spark, d):
    return _clustered(spark, d).select("peak_id", "scan_ord", "rt", "mz", "intensity", "cluster_id")


@query()
def cluster_one_merge(spark, d):
    return clustering.cluster(_points(spark, d), MZ_DIST, min_size=MIN_SIZE, max_merges=1).select("peak_id", "scan_ord", "mz", "cluster_id")


@query(f"WITH RECURSIVE {_LABELS} SELECT cluster_id, count(*) AS n_points, count(DISTINCT scan_ord) AS n_scans, greatest(0, max(intensity)) AS max_intensity FROM k GROUP BY cluster_id ORDER BY n_points DESC, cluster_id LIMIT 50")
def cluster_top_k(spark, d):
    return clustering.cluster_sizes(_clustered(spark, d), 50)


@query(f"WITH RECURSIVE {_LABELS} SELECT cluster_id, max(scan_ord) AS last_seen FROM k GROUP BY 1")
def cluster_last_seen(spark, d):
    return clustering.last_seen(_clustered(spark, d))


@query(f"WITH RECURSIVE {_LABELS} SELECT peak_id, cluster_id, max(scan_ord) OVER (PARTITION BY cluster_id) AS last_seen FROM k")
def cluster_freshened(spark, d):
    return clustering.freshened(_clustered(spark, d)).select("peak_id", "cluster_id", "last_seen")


@query(f"WITH RECURSIVE {_LABELS} SELECT peak_id, cluster_id FROM k x WHERE NOT EXISTS (SELECT 1 FROM k y WHERE x.cluster_id = y.cluster_id AND x.peak_id <> y.peak_id AND abs(x.scan_ord - y.scan_ord) <= 1 AND abs(x.mz - y.mz) <= 1)")
def orphans(spark, d):
    return clustering.orphans(_clustered(spark, d), 1, 1.0).select("peak_id", "cluster_id")


@query(f"WITH RECURSIVE {_LABELS}, n AS (SELECT *, coalesce(mz <> lag(mz) OVER w, true)::INT AS c FROM k WINDOW w AS (PARTITION BY cluster_id ORDER BY mz, rt, peak_id)) SELECT cluster_id, peak_id, sum(c) OVER (PARTITION BY cluster_id ORDER BY mz, rt, peak_id ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM n")
def plot_lines(spark, d):
    return text_files.plot_table(_clustered(spark, d)).select("cluster_id", "peak_id", "line")


@query(f"WITH RECURSIVE {_LABELS} SELECT cluster_id, round(max(rt) - min(rt), 6) AS rt_span, round(max(mz) - min(mz), 6) AS mz_span, max(intensity) AS max_intensity FROM k GROUP BY 1")
def cluster_extents(spark, d):
    k = _clustered(spark, d)
    return k.groupBy("cluster_id").agg(F.round(F.max("rt") - F.min("rt"), 6).alias("rt_span"), F.round(F.max("mz") - F.min("mz"), 6).alias("mz_span"), F.max("intensity").alias("max_intensity"))


def _long(spark: SparkSession, d: str) -> DataFrame:
    """All clusters that keep four scans: what the objective of deadtimes sums over."""
    return preprocess.bright_clusters(_clustered(spark, d), 1, 1.0, 4)


def _bright(spark: SparkSession, d: str) -> DataFrame:
    """The 50 brightest of them."""
    return clustering.brightest(_long(spark, d))


@query(f"WITH RECURSIVE {_LABELS}, f AS (SELECT cluster_id FROM k GROUP BY 1 HAVING count(DISTINCT rt) >= 4), t AS (SELECT cluster_id FROM k SEMI JOIN f USING (cluster_id) GROUP BY 1 ORDER BY max(intensity) DESC, cluster_id LIMIT 50) SELECT cluster_id, peak_id, rt, mz, intensity FROM k SEMI JOIN t USING (cluster_id)")
def brightest_clusters(spark, d):
    return _bright(spark, d).select("cluster_id", "peak_id", "rt", "mz", "intensity")


@query()
def deadtime_search(spark, d):
    return anneal.search_dealt(_long(spark, d))


@query()
def deadtime_grid(spark, d):
    return anneal.grid_search(_long(spark, d), [i * 2 * deadtime.TAU_NE_NS / 99 for i in range(100)], [i * 3 / 99 for i in range(100)])


@query()
def gaussian_fit(spark, d):
    return shapes.volumes(shapes.fit_gaussians(clustering.cluster(_points(spark, d), 5.0, min_size=10), 5.0))


@query()
def meanshift_count(spark, d):
    return shapes.mean_shift_counts(_clustered(spark, d), 2.0)


_NEAR = "y.peak_id < x.peak_id AND x.cluster_id = y.cluster_id AND greatest(abs(x.rt / 86400.0 - y.rt / 86400.0), abs(x.mz - y.mz)) <= 1.5"


@query(f"""WITH RECURSIVE {_LABELS}, near AS MATERIALIZED (SELECT x.peak_id AS a, y.peak_id AS b FROM k x JOIN k y ON {_NEAR}), two AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
core AS MATERIALIZED (SELECT a AS p FROM two GROUP BY 1 HAVING count(*) + 1 >= 3), cl AS MATERIALIZED (SELECT a, b FROM two SEMI JOIN core x ON a = x.p SEMI JOIN core y ON b = y.p),
cr(a, b) AS (SELECT p, p FROM core UNION SELECT cr.a, cl.b FROM cr JOIN cl ON cr.b = cl.a), part AS (SELECT a AS peak_id, min(b) AS part FROM cr GROUP BY 1),
inside AS (SELECT p AS peak_id FROM core UNION SELECT a FROM two SEMI JOIN core ON b = p)
SELECT k.cluster_id, count(DISTINCT part) AS subclusters, count(*) FILTER (inside.peak_id IS NULL) AS noise FROM k LEFT JOIN part USING (peak_id) LEFT JOIN inside USING (peak_id) GROUP BY 1""")
def dbscan_count(spark, d):
    return shapes.density_counts(_clustered(spark, d), 1.5, 3, 86400.0)


@query(f"WITH RECURSIVE {_LABELS} SELECT x.peak_id AS a, y.peak_id AS b FROM k x JOIN k y ON {_NEAR}")
def near_points(spark, d):
    return shapes.near_points(_clustered(spark, d), 1.5, 86400.0)


# --- as-of, grids ---------------------------------------------------------------------------

_HOURS = "ev AS (SELECT event_id AS peak_id, value AS mz, floor(epoch_us(ts) / 3600000000)::BIGINT AS h, epoch_us(ts) / 1e6 AS rt FROM events WHERE value IS NOT NULL)"


@query(f"WITH {_HOURS}, g AS (SELECT DISTINCT h * 3600.0 + 1800 AS rt, h AS grid FROM ev) SELECT ev.peak_id, g.grid FROM ev ASOF LEFT JOIN g ON ev.rt >= g.rt")
def asof_scan(spark, d):
    rows = adapters.event_points(spark, d)
    marks = rows.select((F.col("scan_num") * 3600.0 + 1800).alias("rt"), F.col("scan_num").alias("grid")).distinct()
    return asof.asof(rows.select("peak_id", "rt"), marks, "rt", "grid", "<=").select("peak_id", F.col("found").alias("grid"))


@query(f"WITH {_P}, s AS (SELECT scan_num, min(rt) AS rt FROM p GROUP BY 1) SELECT scan_num, rt, first(scan_num) OVER w AS lo_scan, last(scan_num) OVER w AS hi_scan FROM s WINDOW w AS (ORDER BY rt RANGE BETWEEN 250000 PRECEDING AND 250000 FOLLOWING)")
def rt_neighbours(spark, d):
    scans = _peaks(spark, d).groupBy("scan_num").agg(F.min("rt").alias("rt"))
    return asof.neighbour_range(scans, 250000)


@query(f"WITH {_P}, b AS (SELECT peak_id, mz, floor((sqrt(mz) - {math.sqrt(9.0)!r}) / {(math.sqrt(1000.0) - 3.0) / BLOCKS!r}::DOUBLE)::INT + 1 AS block FROM p WHERE mz > 9 AND mz < 1000), g AS (SELECT *, pow(3.0 + (block - 1) * {(math.sqrt(1000.0) - 3.0) / BLOCKS!r}::DOUBLE, 2) AS lo, pow(3.0 + block * {(math.sqrt(1000.0) - 3.0) / BLOCKS!r}::DOUBLE, 2) AS hi FROM b) SELECT peak_id, mz, block FROM g WHERE mz > lo AND mz < hi")
def mz_blocks(spark, d):
    return grid.mz_blocks(_peaks(spark, d), 9.0, 1000.0, BLOCKS).select("peak_id", "mz", "block")


@query(f"WITH {_P}, g AS (SELECT scan_num, sqrt(mz) - lag(sqrt(mz), 1, 0.0) OVER (PARTITION BY scan_num ORDER BY mz) AS g FROM p) SELECT scan_num, round(min(g), 9) AS gap FROM g GROUP BY 1")
def least_gap(spark, d):
    return grid.least_gap(_peaks(spark, d)).withColumn("gap", F.round("gap", 9))


@query(f"WITH {_P} SELECT scan_num, floor((sqrt(mz) - {math.sqrt(GRID_MIN)!r}) / {GRID_GAP})::INT AS bin, sum(intensity) AS intensity, count(*) AS n_peaks FROM p WHERE mz >= {GRID_MIN} GROUP BY ALL")
def tof_grid(spark, d):
    return grid.tof_grid(_peaks(spark, d), GRID_MIN, GRID_GAP)


@query(f"WITH {_P}, b AS (SELECT *, round((sqrt(mz) - {math.sqrt(GRID_MIN)!r}) / {GRID_GAP})::INT AS bin FROM p), g AS (SELECT *, row_number() OVER (PARTITION BY scan_num, bin ORDER BY mz, peak_id) AS i FROM b WHERE abs(pow({math.sqrt(GRID_MIN)!r} + bin * {GRID_GAP}, 2) - mz) < 1) SELECT peak_id, scan_num, bin FROM g WHERE i = 1")
def grid_matches(spark, d):
    return grid.grid_matches(_peaks(spark, d), GRID_MIN, GRID_GAP, 1.0).select("peak_id", "scan_num", "bin")


# --- sequences ------------------------------------------------------------------------------

_ROWS = ", ".join(f"('{r}', {', '.join(map(str, atoms))})" for r, atoms in isotopes.RESIDUES.items())
_SEQ = f"""res(residue, {', '.join(isotopes.ATOMS)}) AS (VALUES {_ROWS}), q AS (SELECT p_partkey::BIGINT AS seq_id, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS sequence FROM part),
l AS (SELECT seq_id, sequence, unnest(string_split(sequence, '')) AS residue FROM q),
a AS (SELECT seq_id, sequence, {', '.join(f'(coalesce(sum({x}), 0) + {isotopes.ENDS.get(x, 0)})::BIGINT AS {x}' for x in isotopes.ATOMS)} FROM l LEFT JOIN res USING (residue) GROUP BY ALL)"""


@query(f"WITH {_SEQ} SELECT *, round({' + '.join(f'{x} * {m}' for x, m in isotopes.MASSES.items())}, 6) AS mass FROM a")
def residue_composition(spark, d):
    return _rounded(isotopes.with_mass(isotopes.composition(adapters.part_sequences(spark, d))), "mass")


@query(f"WITH {_SEQ}, i AS (SELECT seq_id, deut AS n, unnest(range(deut + 1)) AS idx FROM a) SELECT seq_id, idx::INT AS idx, round(exp(lgamma(n + 1) - lgamma(idx + 1) - lgamma(n - idx + 1)) * pow(0.05, idx) * pow(0.95, n - idx) * 100 + 1e-10, 8) AS pct FROM i")
def fast_exchange_profile(spark, d):
    return isotopes.fast_exchange(isotopes.composition(adapters.part_sequences(spark, d))).withColumn("pct", F.round(F.col("pct") + 1e-10, 8))  # decimal ties go up on either side


def _isotopic(kinds: tuple = isotopes.ISOTOPES) -> str:
    """CTEs of compositions and iso(seq_id, idx, pct): one join a convolution, then the cut behind the mode."""
    log = "lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)"
    steps = [f"{_SEQ}, t0 AS (SELECT seq_id, 0 AS idx, 1.0::DOUBLE AS v FROM a)"]
    for i, (element, offset, p) in enumerate(kinds):
        steps.append(f"b{i} AS (SELECT seq_id, k, CASE WHEN k = 0 THEN pow({1 - p!r}, n) ELSE exp({log}) * pow({p!r}, k) * pow({1 - p!r}, n - k) END AS q FROM (SELECT seq_id, {element} AS n, unnest(range(least({element}, {isotopes.LONGEST}) + 1)) AS k FROM a))")
        steps.append(f"t{i + 1} AS MATERIALIZED (SELECT t.seq_id, idx + k * {offset} AS idx, sum(v * q) AS v FROM t{i} t JOIN b{i} b USING (seq_id) WHERE idx + k * {offset} < {isotopes.LONGEST} GROUP BY ALL)")
    last = len(kinds)
    steps.append(f"full_ AS (SELECT seq_id, idx, v * 100 AS pct, arg_max(idx, struct_pack(a := v, b := -idx)) OVER (PARTITION BY seq_id) AS mode FROM t{last})")
    steps.append(f"iso AS MATERIALIZED (SELECT f.seq_id, idx, pct FROM full_ f LEFT JOIN (SELECT seq_id, min(idx) AS stop FROM full_ WHERE idx >= mode AND pct < {isotopes.LEAST_PERCENT} GROUP BY 1) USING (seq_id) WHERE idx <= coalesce(stop, {isotopes.LONGEST}))")
    return ", ".join(steps)


_LADDER = f"round({' + '.join(f'a.{x} * {m}' for x, m in isotopes.MASSES.items())} + idx * {isotopes.SPACING}, 6) AS mz"


@query(f"WITH {_isotopic()}, top AS (SELECT seq_id, max(pct) AS top FROM (SELECT *, max(idx) OVER (PARTITION BY seq_id) AS last FROM iso) WHERE idx < last OR last = 0 GROUP BY 1) SELECT seq_id, idx::INT AS idx, {_LADDER}, round(pct, 6) AS pct, round(pct / top * 100, 6) AS pct_norm FROM iso JOIN top USING (seq_id) JOIN a USING (seq_id)")
def isotope_profile(spark, d):
    return _rounded(isotopes.profiles(adapters.part_sequences(spark, d), mode=1), "mz", "pct", "pct_norm")


_EXCHANGED = "fast AS (SELECT seq_id, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) * pow(0.05, k) * pow(0.95, n - k) * 100 AS q FROM (SELECT seq_id, deut AS n, unnest(range(deut + 1)) AS k FROM a))"


@query(f"WITH {_isotopic()}, {_EXCHANGED}, both_ AS MATERIALIZED (SELECT i.seq_id, idx + k AS idx, sum(pct * q) / 100 AS pct FROM iso i JOIN fast USING (seq_id) GROUP BY ALL), top AS (SELECT seq_id, max(pct) AS top FROM both_ GROUP BY 1) SELECT seq_id, idx::INT AS idx, {_LADDER}, round(pct, 6) AS pct, round(pct / top * 100, 6) AS pct_norm FROM both_ JOIN top USING (seq_id) JOIN a USING (seq_id)")
def combined_profile(spark, d):
    return _rounded(isotopes.profiles(adapters.part_sequences(spark, d)), "mz", "pct", "pct_norm")


# --- codecs and scalars ---------------------------------------------------------------------


@query(f"WITH {_P} SELECT scan_num, rt, mz, intensity FROM p")
def codec_round_trip(spark, d):
    packed = mzxml.encode_scans(_peaks(spark, d), 64, "zlib").withColumn("rt", duration_seconds(F.col("rt_text")))
    return mzxml.explode_peaks(mzxml.decode_scans(packed)).select("scan_num", "rt", "mz", "intensity")


@query(f"WITH {_P} SELECT printf('%d %.3f %.3f %.3f', scan_num, rt, mz * 10, intensity) AS value FROM p")
def peak_text(spark, d):
    return text_files.peak_lines(_peaks(spark, d).withColumn("mz", F.col("mz") * 10))  # three decimals, so no ties


_DURATION = "(s % 86400) // 3600 AS h, (s % 3600) // 60 AS mi, s % 60 AS se, s // 86400 AS da FROM (SELECT o_orderkey, o_orderkey * 37 AS s FROM orders)"


@query(f"SELECT o_orderkey, (da * 86400 + h * 3600 + mi * 60 + se)::DOUBLE AS seconds, (h * 3600 + mi * 60 + se)::DOUBLE AS without_first FROM (SELECT o_orderkey, {_DURATION})")
def durations(spark, d):
    s = F.col("o_orderkey") * 37
    text = F.format_string("P%dDT%dH%dM%dS", F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)
    rows = adapters.table(spark, d, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", duration_seconds(F.col("t")).alias("seconds"), duration_seconds(F.col("t"), True).alias("without_first"))


@query("SELECT c_custkey, coalesce(try_cast(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT), 0) AS number, 0::BIGINT AS prefix, 0.0::DOUBLE AS prefix_double, abs(trunc(c_acctbal))::DOUBLE AS whole FROM customer")
def lenient_numbers(spark, d):
    rows = adapters.table(spark, d, "customer")
    tail = F.regexp_extract("c_name", "([0-9]+)$", 1)
    return rows.select("c_custkey", lenient_int(tail).alias("number"), lenient_int(F.col("c_name")).alias("prefix"), lenient_double(F.col("c_name")).alias("prefix_double"), int_abs(F.col("c_acctbal")).alias("whole"))


_ISOTOPES = _REGISTRY["isotope_profile"][1]


@query(_ISOTOPES)
def sql_isotope_profile(spark, d):
    sql.register(spark)
    rows = adapters.part_sequences(spark, d).repartition("seq_id")  # a file of small rows is few tasks
    return spark.sql("SELECT s.seq_id, p.idx, round(p.mz, 6) AS mz, round(p.pct, 6) AS pct, round(p.pct_norm, 6) AS pct_norm FROM {rows} s, LATERAL isotope_profile(s.sequence, s.charge) p", rows=rows)


@query(f"SELECT o_orderkey, (da * 86400 + h * 3600 + mi * 60 + se)::DOUBLE AS seconds, round(coalesce(exp(lgamma(h + 1) - lgamma(mi % 8 + 1) - lgamma(h - mi % 8 + 1)), 0) * (h >= mi % 8)::INT, 3) AS ways, abs(trunc(o_totalprice))::DOUBLE AS whole FROM (SELECT o_orderkey, o_totalprice, {_DURATION.replace('SELECT o_orderkey,', 'SELECT o_orderkey, o_totalprice,')})")
def sql_scalars(spark, d):
    sql.register(spark)
    s = F.col("o_orderkey") * 37
    text = F.format_string("P%dDT%dH%dM%dS", F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)
    rows = adapters.table(spark, d, "orders").select("o_orderkey", "o_totalprice", text.alias("t"), F.floor(s % 86400 / 3600).alias("h"), F.floor(s % 3600 / 60).alias("mi"))
    return spark.sql("SELECT o_orderkey, xs_seconds(t) AS seconds, round(choose(h, mi % 8), 3) AS ways, int_abs(CAST(o_totalprice AS DOUBLE)) AS whole FROM {rows}", rows=rows)


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _REGISTRY.items() if text}
