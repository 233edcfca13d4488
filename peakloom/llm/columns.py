"""Names of an input's own columns beside those that an operator adds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def own_columns(df: DataFrame, added: Iterable[str]) -> dict[str, str]:
    """Each column of ``df`` with its name in the result: underscores are appended while it equals an added or earlier one, whatever the case."""
    taken, out = {a.lower() for a in added}, {}
    others = [c.lower() for c in df.columns]
    for c in df.columns:
        name = c
        while name.lower() in taken or (name != c and name.lower() in others):
            name += "_"
        taken.add(name.lower())
        out[c] = name
    return out


def column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")
