"""Scan and peak filters, sampling, numbering, summaries, local maxima and highest peaks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions.ranking import ordinals
from peakloom.functions.shared import written


def filter_peaks(peaks: DataFrame, min_mz: float = 0.0, max_mz: float | None = None, min_intensity: float = 0.0, floor: float | None = None) -> DataFrame:
    """Strict bounds on mz and intensity; ``floor`` is the clusterer's inclusive one."""
    keep = (F.col("intensity") > min_intensity) & (F.col("mz") > min_mz)
    if max_mz is not None:
        keep &= F.col("mz") < max_mz
    if floor is not None:
        keep &= F.col("intensity") >= floor
    return peaks.where(keep)


def sample_scans(scans: DataFrame, scan_type: str = "Full", take: str = "all", rt: tuple[float, float] | None = None, num: tuple[int, int] | None = None, renumber: bool = True, order: str | None = None) -> DataFrame:
    """Scans of one type; every second of them (``even`` keeps the 2nd, 4th, ...) by their order (that of their document, doc_order, where there is one, else num), before the inclusive ranges; numbered anew from 1 as new_num."""
    order = order or ("doc_order" if "doc_order" in scans.columns else "num")
    kept = written(scans.where(F.col("scan_type") == scan_type), "scans")  # a row a scan, which is numbered next
    if take != "all":
        places = ordinals(kept, order, "__place")
        kept = kept.join(places, order).where(F.col("__place") % 2 == (1 if take == "even" else 0)).drop("__place")
    if rt:
        kept = kept.where(F.col("rt").between(*rt))
    if num:
        kept = kept.where(F.col("num").between(*num))
    if not renumber:
        return kept.withColumn("new_num", F.col("num").cast("int"))
    kept = written(kept, "sampled-scans") if take != "all" else kept
    return kept.join(ordinals(kept, order, "__place"), order).withColumn("new_num", F.col("__place") + 1).drop("__place")


def scan_summary(peaks: DataFrame) -> DataFrame:
    """Peaks of each scan: count, range of mz, total and highest intensity, and mz of the highest (the least on ties)."""
    best = F.struct(F.col("intensity"), -F.col("mz"))
    return peaks.groupBy("scan_num").agg(
        F.count(F.lit(1)).alias("n_peaks"), F.min("rt").alias("rt"), F.min("mz").alias("low_mz"), F.max("mz").alias("high_mz"),
        F.max("intensity").alias("base_intensity"), F.max_by("mz", best).alias("base_mz"),
    )


def run_header(scans: DataFrame) -> DataFrame:
    """One row: kept scans, and the original texts of the least and greatest retention times."""
    return scans.agg(F.count(F.lit(1)).alias("scan_count"), F.min_by("rt_text", "rt").alias("start_time"), F.max_by("rt_text", "rt").alias("end_time"))


def fullest_scan(peaks: DataFrame) -> DataFrame:
    """The scan with most peaks, the first on ties."""
    return peaks.groupBy("scan_num").agg(F.count(F.lit(1)).alias("n_peaks")).orderBy(F.desc("n_peaks"), "scan_num").limit(1)


def local_maxima(peaks: DataFrame) -> DataFrame:
    """Peaks that no neighbour in their scan, by mz (then peak_id, where there is one), exceeds; plateaus pass and ends compare one side."""
    w = Window.partitionBy("scan_num").orderBy("mz", *(c for c in ("peak_id",) if c in peaks.columns))
    sides = peaks.withColumns({"__l": F.lag("intensity").over(w), "__r": F.lead("intensity").over(w)})
    return sides.where("not (coalesce(intensity < __l, false) or coalesce(intensity < __r, false))").drop("__l", "__r")


def bright_clusters(points: DataFrame, min_len: int = 4, min_intensity: float = 1.0, min_scans: int = 5) -> DataFrame:
    """Points of scans with enough peaks, one of them bright enough, in clusters that keep enough such scans."""
    scans = points.groupBy("cluster_id", "rt").agg(F.count(F.lit(1)).alias("n"), F.max("intensity").alias("top")).where((F.col("n") >= min_len) & (F.col("top") >= min_intensity))
    clusters = scans.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("scans")).where(F.col("scans") >= min_scans)
    kept = scans.join(clusters.select("cluster_id"), "cluster_id", "left_semi").select("cluster_id", "rt")
    return points.join(kept, ["cluster_id", "rt"], "left_semi")


def _fold(top: list[tuple[float, int, float]], pdf: pd.DataFrame, n: int, scans: int, mz: float, compat: bool) -> list[tuple[float, int, float]]:
    """An ordered fold over candidates: a stored peak that is near absorbs a candidate, being replaced only by a higher one."""
    for scan, m, i in zip(pdf["scan_num"].tolist(), pdf["mz"].tolist(), pdf["intensity"].tolist(), strict=True):
        if len(top) == n and i < top[-1][0]:
            continue
        near = next((k for k, (_, s, x) in enumerate(top) if abs(s - scan) < scans and ((abs(int(x - m)) < 1) if compat else abs(x - m) < mz)), None)
        if near is None:
            top = (top + [(i, scan, m)]) if len(top) < n else top[:-1] + [(i, scan, m)]
        elif top[near][0] < i:
            top[near] = (i, scan, m)
        else:
            continue
        top.sort(key=lambda t: -t[0])
    return top


def _above_threshold(candidates: DataFrame, n: int, scans: int, mz: float) -> DataFrame:
    """``candidates`` without those that cannot matter to the fold.

    A candidate higher than all others in its own and the adjacent cells (as wide as the reach)
    cannot be absorbed, and leaves the list only for higher ones. So with n of these the list ends
    with nothing under the least of them, and lower candidates never change what stays.
    """
    cells = candidates.groupBy(F.floor(F.col("scan_num") / scans).alias("u"), F.floor(F.col("mz") / mz).alias("v")).agg(F.max("intensity").alias("top"), F.count(F.lit(1)).alias("k"), F.count_distinct("intensity").alias("d"))
    around = F.array(*[F.struct((F.col("u") + a).alias("u"), (F.col("v") + b).alias("v")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    rivals = cells.select("top", F.explode(around).alias("q")).groupBy("q.u", "q.v").agg(F.max("top").alias("rival"))
    alone = cells.where("k = d").join(rivals, ["u", "v"], "left").where("rival is null or top > rival")
    least = alone.orderBy(F.desc("top")).limit(n).agg(F.min("top").alias("least"), F.count(F.lit(1)).alias("k")).first()
    return candidates.where(F.col("intensity") >= least["least"]) if least["k"] == n else candidates


def highest_peaks(peaks: DataFrame, n: int = 10, scans: int = 20, mz: float = 0.05, compat: bool = False, cut: bool = True) -> DataFrame:
    """The ``n`` highest local maxima, neighbours in scan and mz suppressed, in scan order.

    The rule depends on order, so one task folds over candidates in the end, with a list of n as its
    state; ``cut`` leaves out those that provably cannot matter first. ``compat`` compares mz by
    whole numbers.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top: list[tuple[float, int, float]] = []
        for batch in batches:
            top = _fold(top, batch, n, scans, mz, compat)
        yield pd.DataFrame({"place": range(1, len(top) + 1), "scan_num": [t[1] for t in top], "mz": [t[2] for t in top], "intensity": [t[0] for t in top]})

    candidates = local_maxima(peaks).select("scan_num", "mz", "intensity")
    if cut:
        candidates = _above_threshold(candidates, n, scans, 1.0 if compat else mz)
    return candidates.repartition(1).sortWithinPartitions("scan_num", "mz").mapInPandas(fold, "place int, scan_num int, mz double, intensity double")
