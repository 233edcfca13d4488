"""Isotope and fast-exchange profiles of peptide sequences."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions.scalars import binomial

# Atoms C, H, N, O, S and exchangeable side hydrogens of each residue.
RESIDUES = {
    "A": (3, 5, 1, 1, 0, 0), "C": (3, 5, 1, 1, 1, 1), "D": (4, 5, 1, 3, 0, 1), "E": (5, 7, 1, 3, 0, 1), "F": (9, 9, 1, 1, 0, 0),
    "G": (2, 3, 1, 1, 0, 0), "H": (6, 7, 3, 1, 0, 1), "I": (6, 11, 1, 1, 0, 0), "K": (6, 12, 2, 1, 0, 2), "L": (6, 11, 1, 1, 0, 0),
    "M": (5, 9, 1, 1, 1, 0), "N": (4, 6, 2, 2, 0, 2), "P": (5, 7, 1, 1, 0, 0), "Q": (5, 8, 2, 2, 0, 2), "R": (6, 12, 4, 1, 0, 4),
    "S": (3, 5, 1, 2, 0, 1), "T": (4, 7, 1, 2, 0, 1), "V": (5, 9, 1, 1, 0, 0), "W": (11, 10, 2, 1, 0, 1), "Y": (9, 9, 1, 2, 0, 1),
}
# What the ends of a chain add, isotopes (element, mass offset, probability), masses, and the spacing of a ladder.
ENDS = {"h": 3, "o": 1, "deut": 4}
ISOTOPES = (("h", 1, 0.00015), ("c", 1, 0.01107), ("n", 1, 0.003663), ("o", 1, 0.000375), ("o", 2, 0.002035), ("s", 1, 0.0076), ("s", 2, 0.0429))
MASSES = {"c": 12.0, "h": 1.007825, "n": 14.00307, "o": 15.99491, "s": 31.9720707}
SPACING, LEAST_PERCENT, LONGEST, MOST_ISOTOPES = 1.003355, 0.005, 30, 100
ATOMS = ("c", "h", "n", "o", "s", "deut")


def residue_table(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(r).alias("residue"), *[F.lit(v).cast("bigint").alias(a) for a, v in zip(ATOMS, atoms, strict=True)]) for r, atoms in RESIDUES.items()])))


def clamp_percent(percent: Column) -> Column:
    """Percent of deuterium; outside [0, 99.9] it is 5."""
    return F.when((percent > 99.9) | (percent < 0), 5.0).otherwise(percent)


def clamp_charge(charge: Column) -> Column:
    """Charge; outside [1, 7] it is 1."""
    return F.when((charge < 1) | (charge > 7), 1).otherwise(charge)


def composition(sequences: DataFrame) -> DataFrame:
    """Atoms of each sequence (seq_id, sequence), ends included; unknown letters count nothing, nulls are left out.

    Letters are counted in the row, and rows are dealt by seq_id ahead of grouping, so that a task
    holds a row a sequence of its own partition alone.
    """
    letters = {r: F.length("sequence") - F.length(F.replace("sequence", F.lit(r), F.lit(""))) for r in RESIDUES}
    counted = sequences.where("sequence is not null").select("seq_id", "sequence", *[k.alias(f"__{r}") for r, k in letters.items()]).repartition("seq_id")
    held = [(a, [F.col(f"__{r}") * atoms[i] for r, atoms in RESIDUES.items() if atoms[i]]) for i, a in enumerate(ATOMS)]
    return counted.groupBy("seq_id", "sequence").agg(*[(F.sum(reduce(Column.__add__, parts)) + ENDS.get(a, 0)).cast("bigint").alias(a) for a, parts in held])


def abundances(table: DataFrame) -> tuple[tuple, dict[str, float]]:
    """Isotopes (element, offset, probability) and masses of elements of an abundance table (a few rows: element, mass_offset, p, mass). An element's mass is that of its first row; those without a row keep theirs."""
    rows = table.limit(MOST_ISOTOPES + 1).collect()
    if len(rows) > MOST_ISOTOPES:
        raise ValueError(f"only {MOST_ISOTOPES} isotopes are allowed")
    rows = [(r.element.lower(), r.mass_offset, r.p, r.mass) for r in rows]
    masses = {e: m for e, _, _, m in reversed(rows) if m is not None}
    return tuple((e, k, p) for e, k, p, _ in rows), MASSES | masses


def with_mass(atoms: DataFrame, masses: dict[str, float] = MASSES) -> DataFrame:
    """``atoms`` with their mass; elements that no residue has count nothing."""
    mass = F.lit(0.0)
    for a, m in ((a, m) for a, m in masses.items() if a in MASSES):
        mass = mass + F.col(a) * m
    return atoms.withColumn("mass", mass)


def ladder_mz(mass: Column, place: Column, charge: Column) -> Column:
    """m/z of the place-th peak of a ladder."""
    m = mass + place * SPACING
    return F.when(charge == 1, m).otherwise((m + charge - 1) / charge)


def fast_exchange(atoms: DataFrame, percent: float = 5.0) -> DataFrame:
    """seq_id, idx, pct: binomial share of idx deuterons on the exchangeable side hydrogens."""
    d = clamp_percent(F.lit(float(percent))) / 100
    rows = atoms.select("seq_id", "deut", F.explode(F.sequence(F.lit(0), F.col("deut").cast("int"))).alias("idx"))
    return rows.select("seq_id", "idx", (binomial(F.col("deut"), F.col("idx"), d) * 100).alias("pct"))


def isotope_percent(atoms: dict[str, int], isotopes: tuple = ISOTOPES) -> np.ndarray:
    """Percent at each mass offset: the convolution of every isotope's binomial; cut, inclusive, at the first value under LEAST_PERCENT behind the mode."""
    total = np.ones(1)
    for element, offset, p in isotopes:
        n = atoms.get(element, 0)
        k = np.arange(min(n, LONGEST) + 1)
        steps = (n - k[1:] + 1) / k[1:] * p / (1 - p)
        pmf = np.concatenate([[1.0], np.cumprod(steps)]) * (1 - p) ** n
        spread = np.zeros(offset * (len(pmf) - 1) + 1)
        spread[::offset] = pmf
        total = np.convolve(total, spread)[:LONGEST]
    out = total * 100
    mode = int(out.argmax())
    low = np.flatnonzero(out[mode:] < LEAST_PERCENT)
    return out[: mode + low[0] + 1] if len(low) else out


def isotope_profile(atoms: DataFrame, isotopes: tuple = ISOTOPES) -> DataFrame:
    """seq_id, idx, pct of the isotope distribution."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parts = [isotope_percent(dict(zip("chnos", row[1:], strict=True)), isotopes) for row in f[["seq_id", *"chnos"]].itertuples(index=False, name=None)]
            sizes = [len(p) for p in parts]
            yield pd.DataFrame({"seq_id": np.repeat(f["seq_id"].to_numpy(), sizes), "idx": np.concatenate([np.arange(n) for n in sizes]) if sizes else [], "pct": np.concatenate(parts) if parts else []})

    return atoms.select("seq_id", *"chnos").mapInPandas(run, "seq_id bigint, idx int, pct double")


def combined_profile(isotopic: DataFrame, fast: DataFrame) -> DataFrame:
    """seq_id, idx, pct: discrete convolution of both profiles."""
    f = fast.select("seq_id", F.col("idx").alias("j"), F.col("pct").alias("q"))
    return isotopic.join(f, "seq_id").groupBy("seq_id", (F.col("idx") + F.col("j")).alias("idx")).agg((F.sum(F.col("pct") * F.col("q")) / 100).alias("pct"))


def profiles(sequences: DataFrame, percent: float = 5.0, mode: int = 0, abundance: DataFrame | None = None) -> DataFrame:
    """seq_id, idx, mz, pct, pct_norm of each sequence. mode 1: isotopes, 2: fast exchange, else both combined; ``abundance`` replaces the isotopes.

    pct_norm is relative to the highest value; for isotopes the last kept entry does not count for it.
    """
    isotopes, masses = (ISOTOPES, MASSES) if abundance is None else abundances(abundance)
    atoms = with_mass(composition(sequences), masses).join(sequences.select("seq_id", clamp_charge(F.col("charge")).alias("charge")), "seq_id")
    isotopic, fast = isotope_profile(atoms, isotopes), fast_exchange(atoms, percent)
    rows = isotopic if mode == 1 else fast if mode == 2 else combined_profile(isotopic, fast)
    top = rows.groupBy("seq_id").agg(F.max("pct").alias("top"), F.max(F.struct("idx", "pct")).alias("last"), F.max_by("pct", "pct").alias("any"))
    if mode == 1:
        ahead = rows.join(top.select("seq_id", F.col("last.idx").alias("end")), "seq_id").where("idx < end or end = 0").groupBy("seq_id").agg(F.max("pct").alias("top"))
        top = ahead
    joined = rows.join(top.select("seq_id", "top"), "seq_id").join(atoms.select("seq_id", "mass", "charge"), "seq_id")
    return joined.select("seq_id", "idx", ladder_mz(F.col("mass"), F.col("idx"), F.col("charge")).alias("mz"), "pct", (F.col("pct") / F.col("top") * 100).alias("pct_norm"))


def profile_lines(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """seq_id, place and value of the printed profiles: each sequence's header with its charge, its rows in order, and a blank line."""
    printed = rows.select("seq_id", F.col("idx").alias("place"), F.format_string("%d %10.4f %5.2f  %5.2f", "idx", "mz", "pct", "pct_norm").alias("value"))
    head = sequences.select("seq_id", F.lit(-1).alias("place"), F.format_string("%s  %d", "sequence", clamp_charge(F.col("charge"))).alias("value"))
    blank = sequences.select("seq_id", F.lit((1 << 31) - 1).alias("place"), F.lit("").alias("value"))
    return head.unionByName(printed).unionByName(blank)


def write_profiles(rows: DataFrame, sequences: DataFrame, path: str) -> None:
    """``profile_lines`` as text below ``path``, whose files in their order are the print."""
    lines = profile_lines(rows, sequences).repartitionByRange("seq_id").sortWithinPartitions("seq_id", "place")
    lines.select("value").write.text(path)
