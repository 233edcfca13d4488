"""Blocks of square-root mz and time-of-flight grids."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mz_blocks(peaks: DataFrame, min_mz: float, max_mz: float, blocks: int) -> DataFrame:
    """``peaks`` with block (from 1): ranges of equal width in square-root mz, whose bounds are strict, so that peaks on an edge fall out."""
    lo, step = math.sqrt(min_mz), (math.sqrt(max_mz) - math.sqrt(min_mz)) / blocks
    place = F.floor((F.sqrt("mz") - lo) / step).cast("int")
    edge = lambda k: F.pow(F.lit(lo) + k * step, F.lit(2.0))
    placed = peaks.where((F.col("mz") > min_mz) & (F.col("mz") < max_mz)).withColumn("block", place + 1)
    return placed.where((F.col("mz") > edge(F.col("block") - 1)) & (F.col("mz") < edge(F.col("block"))))


def least_gap(peaks: DataFrame) -> DataFrame:
    """Least gap in square-root mz of each scan; the first gap counts from 0."""
    w = Window.partitionBy("scan_num").orderBy("mz")
    return peaks.withColumn("__g", F.sqrt("mz") - F.lag(F.sqrt("mz"), 1, 0.0).over(w)).groupBy("scan_num").agg(F.min("__g").alias("gap"))


def tof_grid(peaks: DataFrame, min_mz: float, gap: float) -> DataFrame:
    """Sparse (scan_num, bin, intensity, n_peaks) of the grid mz = (sqrt(min_mz) + bin * gap) ** 2."""
    place = F.floor((F.sqrt("mz") - math.sqrt(min_mz)) / gap).cast("int")
    return peaks.where(F.col("mz") >= min_mz).groupBy("scan_num", place.alias("bin")).agg(F.sum("intensity").alias("intensity"), F.count(F.lit(1)).alias("n_peaks"))


def grid_matches(peaks: DataFrame, min_mz: float, gap: float, tolerance: float, compat: bool = False) -> DataFrame:
    """Peaks on the grid: nearest bin within ``tolerance``, one peak a bin and scan, the one of least mz (then peak_id). ``compat`` compares whole numbers."""
    near = F.round((F.sqrt("mz") - math.sqrt(min_mz)) / gap).cast("int")
    binned = peaks.withColumn("bin", near).withColumn("grid_mz", F.pow(F.lit(math.sqrt(min_mz)) + F.col("bin") * gap, F.lit(2.0)))
    off = F.col("grid_mz") - F.col("mz")
    kept = binned.where(F.abs(off.cast("bigint")) < 1 if compat else F.abs(off) < tolerance)
    w = Window.partitionBy("scan_num", "bin").orderBy("mz", *(c for c in ("peak_id",) if c in peaks.columns))
    return kept.withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i")


def grid_matches_in_order(peaks: DataFrame, min_mz: float, gap: float, bins: int, tolerance: float, compat: bool = False) -> DataFrame:
    """Peaks (scan_num, bin and their own columns) on the first ``bins`` bins: each, in mz order, takes the first bin behind those taken that is within ``tolerance``.

    Peaks below the first bin or above the end of the last are passed over. ``compat`` compares whole
    numbers. The rule depends on order, so a scan is folded whole.
    """
    mzs = (math.sqrt(min_mz) + np.arange(bins + 1) * gap) ** 2
    reach = 1.0 if compat else tolerance
    order = [c for c in ("mz", "peak_id") if c in peaks.columns]

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        values = pdf["mz"].to_numpy()
        # differences under the reach: whole numbers of a difference are 0 where it lies strictly between -1 and 1
        lows = np.searchsorted(mzs, values - reach, "right")
        taken, free = np.full(len(values), -1), 0
        for i, (mz, low) in enumerate(zip(values.tolist(), lows.tolist(), strict=True)):
            if mz < mzs[0] - tolerance or mz > mzs[-1] + tolerance:
                continue
            c = max(free, low)
            if c < bins and mzs[c] - mz < reach:
                taken[i], free = c, c + 1
            if free >= bins:
                break
        return pdf.assign(bin=taken.astype("int32"))[taken >= 0]

    schema = ", ".join(f"`{n}` {t}" for n, t in peaks.dtypes)
    return peaks.groupBy("scan_num").applyInPandas(scan, f"{schema}, bin int")
