"""Star-schema and event tables as the canonical table peaks(peak_id, scan_num, rt, mz, intensity)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions.ranking import ordinals


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan is a ship date, rt its seconds since the first; mz is price / 100, intensity the quantity, and peak_id 60 bits of a hash of the keys."""
    key = [F.col(c).cast("bigint") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]  # order and line alone repeat
    rows = table(spark, sf_dir, "lineitem").select(
        F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 15), 16, 10).cast("bigint").alias("peak_id"),
        F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("__at"),
        F.col("l_returnflag").alias("scan_type"),
        (F.col("l_extendedprice").cast("double") / 100).alias("mz"),
        F.col("l_quantity").cast("double").alias("intensity"),
    )
    scans = ordinals(rows, "__at", "scan_num")
    first = scans.where("scan_num = 0").first()
    start = first["__at"] if first else 0
    return rows.join(scans, "__at").select("peak_id", F.col("scan_num"), (F.col("__at") - start).cast("double").alias("rt"), "mz", "intensity", "scan_type")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan is an hour; mz is the event's value, rt its seconds."""
    rows = table(spark, sf_dir, "events").where("value is not null")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.select(F.col("event_id").cast("bigint").alias("peak_id"), F.floor(at / 3_600_000_000).cast("bigint").alias("scan_num"), (at / 1e6).alias("rt"), F.col("value").cast("double").alias("mz"))


def embedding_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan is a vector; mz is the place of a component and intensity its value."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("bigint").alias("scan_num"), F.posexplode("embedding").alias("pos", "v")).select("scan_num", F.col("pos").cast("double").alias("mz"), F.col("v").cast("double").alias("intensity"))


def part_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as residue sequences: upper case, letters only."""
    rows = table(spark, sf_dir, "part")
    return rows.select(F.col("p_partkey").cast("bigint").alias("seq_id"), F.regexp_replace(F.upper("p_name"), "[^A-Z]", "").alias("sequence"), F.lit(1).alias("charge"))
