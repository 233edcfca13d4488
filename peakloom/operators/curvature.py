"""Centroid traces of clusters, cubic fits and the curvature objective."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def centroids(points: DataFrame, by: tuple[str, ...] = ("cluster_id", "rt"), centroid: str = "mean", intensity: str = "intensity") -> DataFrame:
    """Intensity-weighted mean mz of each group, or the mz of its highest peak. Decimal columns are summed exactly."""
    i = F.col(intensity)
    value = F.sum(F.col("mz") * i).cast("double") / F.sum(i).cast("double") if centroid == "mean" else F.max_by("mz", F.struct(i, -F.col("mz")))
    return points.groupBy(*by).agg(value.alias("mz"), F.count(F.lit(1)).alias("n"))


def moments(trace: DataFrame, degree: int = 3, scale: float = 1.0) -> DataFrame:
    """Sums for the normal equations of a polynomial fit of mz over scaled rt, by cluster: native, mergeable, one pass."""
    t = F.col("rt") / scale
    sums = [F.sum(F.pow(t, k)).alias(f"t{k}") for k in range(1, 2 * degree + 1)] + [F.sum(F.pow(t, k) * F.col("mz")).alias(f"m{k}") for k in range(degree + 1)]
    return trace.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), *sums)


def curvature(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Curvature of the polynomial with coefficients ``p`` (highest first)."""
    first, second = np.polyder(p, 1), np.polyder(p, 2)
    return np.polyval(second, t) / (1 + np.polyval(first, t) ** 2) ** 1.5


def trace_curvature(rt: np.ndarray, mz: np.ndarray, shift_and_scale: bool = False) -> float:
    """Sum of the curvature of a cubic least-squares fit over the trace's times; the option fits (mz - min) * 100."""
    mz = (mz - mz.min()) * 100 if shift_and_scale else mz
    middle, spread = rt.mean(), np.ptp(rt) or 1.0
    p = np.polyfit((rt - middle) / spread, mz, min(3, len(rt) - 1))
    x, k = (rt - middle) / spread, np.polyder(p, 1)
    first, second = np.polyval(k, x) / spread, np.polyval(np.polyder(k, 1), x) / spread**2
    return float((second / (1 + first**2) ** 1.5).sum())


def cluster_curvature(trace: DataFrame, shift_and_scale: bool = False) -> DataFrame:
    """cluster_id, n, curvature of each trace (cluster_id, rt, mz)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cluster_id": pdf["cluster_id"].iloc[:1], "n": [len(pdf)], "curvature": [trace_curvature(pdf["rt"].to_numpy(), pdf["mz"].to_numpy(), shift_and_scale)]})

    return trace.select("cluster_id", "rt", "mz").groupBy("cluster_id").applyInPandas(fit, "cluster_id bigint, n bigint, curvature double")


def objective(trace: DataFrame) -> DataFrame:
    """One row: sum over clusters of the absolute summed curvature."""
    return cluster_curvature(trace).agg(F.sum(F.abs("curvature")).alias("total_curvature"))
