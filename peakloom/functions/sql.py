"""Functions of the peak engine for SQL: scalar ones with SQL bodies, and profiles as a table function.

``register(spark)`` makes them known to the session. Scalar functions are expanded into the plan by the
analyser, so they are optimised and compiled like what is written out. The table function is called
laterally for each row; rows travel pickled, since an Arrow batch for each call costs more than its rows (functions of whole batches may not stand in lateral
joins).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from peakloom.functions.scalars import DATE_UNITS, TIME_UNITS
from peakloom.operators.isotopes import ATOMS, ENDS, ISOTOPES, MASSES, RESIDUES, SPACING, isotope_percent

_NUMBER = r"^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)"


def _seconds(part: str, units: tuple) -> str:
    return " + ".join(rf"coalesce(try_cast(regexp_extract({part}, '(\\d+\\.?\\d*){unit}', 1) AS DOUBLE), 0D) * {seconds}D" for unit, seconds in units)


#: Signature, type and body of each scalar function.
SCALARS = {
    "xs_seconds(t STRING)": ("DOUBLE", rf"CASE WHEN t IS NOT NULL THEN {_seconds("regexp_extract(t, 'P([^T]*)', 1)", DATE_UNITS)} + {_seconds("regexp_extract(t, 'T(.*)$', 1)", TIME_UNITS)} END"),
    "lenient_double(t STRING)": ("DOUBLE", f"coalesce(try_cast(regexp_extract(t, '{_NUMBER}', 1) AS DOUBLE), 0D)"),
    "lenient_int(t STRING)": ("BIGINT", r"coalesce(try_cast(regexp_extract(t, '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0L)"),
    "int_abs(x DOUBLE)": ("DOUBLE", "CAST(abs(CAST(x AS BIGINT)) AS DOUBLE)"),
    "choose(n BIGINT, k BIGINT)": ("DOUBLE", "CASE WHEN k < 0 OR k > n THEN 0D WHEN k = 0 THEN 1D ELSE aggregate(sequence(1, CAST(greatest(k, 1) AS INT)), 1D, (acc, i) -> acc * (n - k + i) / i) END"),
    "binomial(n BIGINT, k BIGINT, p DOUBLE)": ("DOUBLE", "choose(n, k) * pow(p, k) * pow(1 - p, n - k)"),
    "flight_seconds(mz DOUBLE, a DOUBLE)": ("DOUBLE", "a * sqrt(mz)"),
    "ladder_mz(mass DOUBLE, place BIGINT, charge BIGINT)": ("DOUBLE", f"CASE WHEN charge = 1 THEN mass + place * {SPACING}D ELSE (mass + place * {SPACING}D + charge - 1) / charge END"),
}


@functools.lru_cache(1 << 14)
def _percent(*counts: int) -> np.ndarray:
    """``isotope_percent`` of numbers of C, H, N, O and S, which sequences of the same letters share."""
    return isotope_percent(dict(zip("chnos", counts, strict=True)), ISOTOPES)


def _profile(sequence: str | None, charge: int | None) -> list[tuple[int, float, float, float]]:
    """idx, mz, percent and percent of the highest of a sequence's isotopes."""
    atoms = {a: ENDS.get(a, 0) + sum(RESIDUES[r][i] for r in sequence or "" if r in RESIDUES) for i, a in enumerate(ATOMS)}
    mass = sum(atoms[a] * m for a, m in MASSES.items())
    charge = 1 if charge is None or not 1 <= charge <= 7 else charge
    percent = _percent(*[atoms[a] for a in "chnos"])
    top = percent[:-1].max() if len(percent) > 1 else percent.max()
    m = mass + np.arange(len(percent)) * SPACING
    mz = m if charge == 1 else (m + charge - 1) / charge
    return list(zip(range(len(percent)), mz.tolist(), percent.tolist(), (percent / top * 100).tolist(), strict=True))


@udtf(returnType="idx int, mz double, pct double, pct_norm double", useArrow=False)
class IsotopeProfile:
    """The isotope series of a peptide sequence; null sequences are empty ones, charges outside 1 to 7 and null are 1, unknown letters count nothing."""

    def eval(self, sequence: str | None, charge: int | None) -> Iterator[tuple[int, float, float, float]]:
        yield from _profile(sequence, charge)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session; those of the same names are replaced."""
    for signature, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    spark.udtf.register("isotope_profile", IsotopeProfile)
