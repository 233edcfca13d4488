"""Scalar functions of the peak engine, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds in each unit of an xs:duration; a month has 30 days and a year 360.
DATE_UNITS = (("Y", 360 * 86400.0), ("M", 30 * 86400.0), ("D", 86400.0))
TIME_UNITS = (("H", 3600.0), ("M", 60.0), ("S", 1.0))


def lenient_double(text: Column) -> Column:
    """Number at the start of ``text``, else 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def lenient_int(text: Column) -> Column:
    """Integer at the start of ``text``, else 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def duration_seconds(text: Column, lose_first_date_part: bool = False) -> Column:
    """Seconds of an xs:duration; signs are ignored. The option drops the first part ahead of T, as an older reader did."""
    date = F.regexp_extract(text, r"P([^T]*)", 1)
    date = F.regexp_replace(date, r"^[^YMD]*[YMD]", "") if lose_first_date_part else date
    time = F.regexp_extract(text, r"T(.*)$", 1)
    total = F.lit(0.0)
    for part, units in ((date, DATE_UNITS), (time, TIME_UNITS)):
        for unit, seconds in units:
            total = total + F.coalesce(F.regexp_extract(part, rf"(\d+\.?\d*){unit}", 1).try_cast("double"), F.lit(0.0)) * seconds
    return F.when(text.isNotNull(), total)


def seconds_of(text: str | None) -> float | None:
    """``duration_seconds`` of one text."""
    if text is None:
        return None
    date, _, time = text.partition("P")[2].partition("T")
    parts = [(part, unit, seconds) for part, units in ((date, DATE_UNITS), (time, TIME_UNITS)) for unit, seconds in units]
    return sum((float(m[1]) * seconds for part, unit, seconds in parts if (m := re.search(rf"([0-9]+\.?[0-9]*){unit}", part))), 0.0)


def int_abs(x: Column) -> Column:
    """Absolute value of ``x`` cut to an integer."""
    return F.abs(x.cast("bigint")).cast("double")


def combinations(n: Column, k: Column) -> Column:
    """n over k as a double; 0 where k > n or k < 0."""
    product = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), F.lit(1.0), lambda acc, i: acc * (n - k + i) / i)
    return F.when((k < 0) | (k > n), 0.0).when(k == 0, 1.0).otherwise(product)


def binomial(n: Column, k: Column, p: Column) -> Column:
    return combinations(n, k) * F.pow(p, k) * F.pow(1 - p, n - k)
