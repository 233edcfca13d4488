"""As-of look-ups and neighbourhoods in sorted keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions.shared import written

MODES = (">", ">=", "=", "<=", "<")


def asof(left: DataFrame, right: DataFrame, key: str, value: str, mode: str = "<=", by: str | None = None, out: str = "found") -> DataFrame:
    """``left`` with the nearest right ``value`` by ``key``: the greatest at or below it (``<=``, ``<``), the least at or above it, or the equal one.

    Rows of both sides are dealt to ranges of keys, which Spark samples, and looked through in order
    inside each; what a range lacks comes from the nearest range beside it that has a key (a row a
    range). ``by`` names a column that both have and that splits the keys instead. Of right rows with
    equal keys the least value counts.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    part = [by] if by else []
    right, value = right.groupBy(*part, key).agg(F.min(value).alias("__value")), "__value"
    if mode == "=":
        return left.join(right.select(*part, key, F.col(value).alias(out)), [*part, key], "left")
    first = mode in ("<=", ">")  # on equal keys, right rows come ahead of left ones
    rows = left.select(*part, F.col(key).alias("__k"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(dict(right.dtypes)[value]).alias("__v"), F.lit(int(first)).alias("__side"))
    keys = right.select(*part, F.col(key).alias("__k"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"), F.lit(int(not first)).alias("__side"))
    both = rows.unionByName(keys)
    if not by:
        both = written(both.repartitionByRange("__k").sortWithinPartitions("__k", "__side").withColumn("__part", F.spark_partition_id()), "asof-ranges")
        part = ["__part"]
    below = mode in ("<=", "<")
    # keys above are looked through from behind: frames that end with the last row are computed anew for each row
    order = [F.col("__k"), F.col("__side")] if below else [F.desc("__k"), F.desc("__side")]
    frame = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(out, F.last("__v", ignorenulls=True).over(frame)).where("__row is not null")
    if not by:
        found = found.join(F.broadcast(_beside(both, below)), "__part", "left").withColumn(out, F.coalesce(out, "__beside"))
    return found.select("__row.*", out)


def _beside(both: DataFrame, below: bool) -> DataFrame:
    """For each range of keys, the value of the last key of the ranges ahead (``below``), or of the first key behind."""
    edge = (F.max_by if below else F.min_by)("__v", F.when(F.col("__v").isNotNull(), F.col("__k")))
    edges = both.groupBy("__part").agg(edge.alias("__e"))
    w = Window.orderBy("__part")  # a row a range
    frame = w.rowsBetween(Window.unboundedPreceding, -1) if below else w.rowsBetween(1, Window.unboundedFollowing)
    return edges.select("__part", (F.last if below else F.first)("__e", ignorenulls=True).over(frame).alias("__beside"))


def neighbour_range(scans: DataFrame, reach: float, by: str | None = None) -> DataFrame:
    """Scans (scan_num, rt) with the first and last scan within ``reach`` of their retention time.

    Times are cut into cells as long as the reach, and each scan is shown to its own cell and the two
    beside it, so that a cell's window is whole.
    """
    cell = F.floor(F.col("rt") / float(reach)).cast("long")
    shown = scans.withColumn("__own", cell).withColumn("__cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    frame = f"over (partition by {f'{by}, ' if by else ''}__cell order by rt range between {float(reach)!r}D preceding and {float(reach)!r}D following)"
    found = shown.withColumns({"lo_scan": F.expr(f"first(scan_num) {frame}"), "hi_scan": F.expr(f"last(scan_num) {frame}")})
    return found.where("__cell = __own").drop("__own", "__cell")
