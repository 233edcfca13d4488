"""Dense global numbering without bringing all keys into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions.shared import written

_PLACE_BITS = 33  # of monotonically_increasing_id: partition above, place inside it below


def places(df: DataFrame, by: str, order: list[str], name: str = "place") -> DataFrame:
    """``df`` with the place from 1 of each row among those of equal ``by``, in ``order``; rows of one value are dealt to ranges too.

    Places inside a range are moved on by what the ranges ahead hold of the value (a row a range and value).
    """
    placed = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("__part", F.spark_partition_id())
    placed = written(placed, "ranged")
    sizes = placed.groupBy("__part", by).agg(F.count(F.lit(1)).alias("__n"))
    ahead = sizes.select("__part", by, (F.sum("__n").over(Window.partitionBy(by).orderBy("__part")) - F.col("__n")).alias("__ahead"))
    local = placed.withColumn("__i", F.row_number().over(Window.partitionBy("__part", by).orderBy(*order)))
    return local.join(ahead, ["__part", by]).withColumn(name, (F.col("__ahead") + F.col("__i")).cast("int")).select(*df.columns, name)


def ordinals(df: DataFrame, key: str, name: str = "ordinal", kind: str = "int") -> DataFrame:
    """Distinct values of the column ``key``, whatever its type, with their places from 0, as a written table of one pass over ``df``.

    Keys are dealt to ranges that Spark samples, so that outliers do not fill one, and sorted there;
    places inside a range are moved on by the sizes of the ranges ahead (a row for each of them).
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    placed = keys.repartitionByRange(key).sortWithinPartitions(key).withColumn("__m", F.monotonically_increasing_id())
    placed = written(placed.select(key, F.shiftright("__m", _PLACE_BITS).alias("__r"), F.col("__m").bitwiseAND((1 << _PLACE_BITS) - 1).alias("__i")), "ordinals")
    sizes = placed.groupBy("__r").agg((F.max("__i") + 1).alias("__n"))
    ahead = sizes.select("__r", (F.sum("__n").over(Window.orderBy("__r")) - F.col("__n")).alias("__ahead"))
    return placed.join(F.broadcast(ahead), "__r").select(key, (F.col("__ahead") + F.col("__i")).cast(kind).alias(name))
