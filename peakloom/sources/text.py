"""Plain-text tables: peaks, clusters, file lists, sequences and abundances."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.functions.ranking import places
from peakloom.functions.shared import written

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_PEAK = rf"^\s*(\S+)\s+({_NUMBER})\s+({_NUMBER})\s+({_NUMBER})"
_POINT = r"(\d+)\s+(\d+\.\d+)\s+(\d+\.\d+)\s+(\d+\.\d+)"
CLUSTER_FILE = r"^(\d{6})\.clust$"
#: Lines that a task holds as Python strings.
LINES = 4096


def _double(pattern: str, group: int) -> Column:
    return F.regexp_extract("value", pattern, group).try_cast("double")


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """scan_num, rt, mz, intensity of lines with four fields; lines without three numbers behind the first are skipped."""
    rows = spark.read.text(path).where(F.col("value").rlike(_PEAK))
    return rows.select(F.regexp_extract("value", _PEAK, 1).try_cast("int").alias("scan_num"), _double(_PEAK, 2).alias("rt"), _double(_PEAK, 3).alias("mz"), _double(_PEAK, 4).alias("intensity"))


def peak_lines(peaks: DataFrame) -> DataFrame:
    """Lines of peaks. Decimal ties are rounded up, where C rounds the binary value."""
    return peaks.select(F.format_string("%d %.3f %.3f %.3f", F.col("scan_num").cast("bigint"), "rt", "mz", "intensity").alias("value"))


def write_peaks(peaks: DataFrame, path: str) -> None:
    peak_lines(peaks).write.text(path)


def discard(df: DataFrame) -> None:
    """Run ``df`` without keeping anything."""
    df.write.format("noop").mode("overwrite").save()


def read_clusters(spark: SparkSession, path: str, strict: bool = False, recursive: bool = False) -> DataFrame:
    """cluster_id (of the file's name), scan_ord, rt, mz, intensity of all files NNNNNN.clust; other lines are skipped, or an error if ``strict``."""
    reader = spark.read.option("pathGlobFilter", "*.clust")
    rows = (reader.option("recursiveFileLookup", "true") if recursive else reader).text(path)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    rows = rows.withColumn("__name", name).where(F.col("__name").rlike(CLUSTER_FILE))
    if strict:
        rows = rows.where(F.when(F.col("value").rlike(_POINT), True).otherwise(F.raise_error(F.concat(F.lit("not a point: "), F.col("value"))).isNull()))
    rows = rows.where(F.col("value").rlike(_POINT))
    return rows.select(F.regexp_extract("__name", CLUSTER_FILE, 1).cast("int").alias("cluster_id"), F.regexp_extract("value", _POINT, 1).cast("int").alias("scan_ord"), _double(_POINT, 2).alias("rt"), _double(_POINT, 3).alias("mz"), _double(_POINT, 4).alias("intensity"))


def cluster_lines(points: DataFrame) -> DataFrame:
    return points.select("cluster_id", F.format_string("%6d %9.3f %9.3f %9.3f", F.col("scan_ord").cast("bigint"), "rt", "mz", "intensity").alias("value"))


def write_clusters(points: DataFrame, path: str) -> None:
    """One folder of text a cluster; a table partitioned by cluster_id is preferable for many clusters."""
    cluster_lines(points).repartition("cluster_id").write.partitionBy("cluster_id").text(path)


def cluster_parts(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes the files of lines (cluster_id, value) that come cluster after cluster; a row a file."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    key, out, part, n = None, None, "", 0

    def close() -> pa.RecordBatch:
        out.close()
        name = f"{path}/{key:06d}.clust"
        system.move(part, name)
        return pa.RecordBatch.from_pydict({"cluster_id": [key], "path": [name], "n_points": [n]})

    for whole in batches:
        for batch in (whole.slice(at, LINES) for at in range(0, whole.num_rows, LINES)):
            ids, values = batch["cluster_id"].to_numpy(), batch["value"]
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            for i, j in zip(starts.tolist(), np.append(starts[1:], len(ids)).tolist(), strict=True):
                if out is not None and ids[i] != key:
                    yield close()
                    out = None
                if out is None:
                    key, n = int(ids[i]), 0
                    part = f"{path}/.{key:06d}.{uuid.uuid4().hex}"
                    out = system.open_output_stream(part)
                out.write("".join(f"{x}\n" for x in values.slice(i, j - i).to_pylist()).encode())
                n += j - i
    if out is not None:
        yield close()


def write_cluster_files(points: DataFrame, folder: str) -> DataFrame:
    """A file NNNNNN.clust for each cluster below the URI ``folder``, points by scan and mz; cluster_id, path and points of each. Files appear whole, also when a task runs again; lines are written as they come, so a task holds some of them."""

    rows = points.select(F.col("cluster_id").cast("long").alias("cluster_id"), "scan_ord", "rt", "mz", "intensity").repartition("cluster_id").sortWithinPartitions("cluster_id", "scan_ord", "mz", "intensity")
    return written(cluster_lines(rows).mapInArrow(lambda batches: cluster_parts(batches, folder), "cluster_id long, path string, n_points long"), "cluster-files")


def corrected_lines(points: DataFrame) -> DataFrame:
    """Lines of corrected clusters (scan_ord, rt, mz, corrected), with their cluster_id and place: by retention time, then mz."""
    points = places(points, "cluster_id", ["rt", "mz", "corrected"])
    return points.select("cluster_id", "place", F.format_string("%s %.3f %.3f %.3f", F.col("scan_ord").cast("string"), "rt", "mz", "corrected").alias("value"))


def write_corrected(points: DataFrame, path: str) -> None:
    """A folder of text for each corrected cluster, its lines in order."""
    lines = corrected_lines(points).repartition("cluster_id").sortWithinPartitions("cluster_id", "place")
    lines.select("cluster_id", "value").write.partitionBy("cluster_id").text(path)


def read_file_list(spark: SparkSession, path: str, first_only: bool = True) -> DataFrame:
    """path: the first token of each line, or all space-separated tokens."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    if first_only:
        return lines.select(F.split(F.trim("value"), r"\s+")[0].alias("path"))
    return lines.select(F.explode(F.split(F.rtrim("value"), " ")).alias("path")).where("path <> ''")


def existing_clusters(paths: DataFrame, found: DataFrame) -> DataFrame:
    """Listed paths that are among the ``found`` files and whose name holds "clust"."""
    return paths.where(F.col("path").contains("clust")).join(found, "path", "left_semi")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """seq_id (increasing along a file), sequence and charge (1 where absent) of each line."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''")
    return rows.select(F.monotonically_increasing_id().alias("seq_id"), parts[0].alias("sequence"), F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(1)).alias("charge"))


def read_abundances(spark: SparkSession, path: str) -> DataFrame:
    """element, mass_offset, p, mass of lines with an offset of 1 at least."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("element"), F.get(parts, F.lit(1)).try_cast("int").alias("mass_offset"), F.get(parts, F.lit(2)).try_cast("double").alias("p"), F.get(parts, F.lit(3)).try_cast("double").alias("mass"))
    return rows.where("mass_offset >= 1 and p is not null")


def plot_table(points: DataFrame, by_text: bool = False) -> DataFrame:
    """Points of each cluster as plot lines: a new line starts where mz changes, in mz order (by its text if ``by_text``).

    Points are sorted in ranges over all clusters, so that a large one is dealt to several tasks; what
    a range adds to a cluster's lines goes on to the next ranges (a row a range and cluster).
    """
    order = ["cluster_id", "__t", "rt", "mz", *(c for c in ("peak_id",) if c in points.columns)]
    keyed = points.withColumn("__t", F.format_string("%.3f", "mz") if by_text else F.col("mz"))
    placed = written(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "plot-points")
    w = Window.partitionBy("__part", "cluster_id").orderBy(*order[1:])
    changed = F.coalesce((F.col("mz") != F.lag("mz").over(w)).cast("int"), F.lit(0))
    local = placed.withColumn("__new", changed).withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    key = F.struct(*order[1:])
    ends = placed.groupBy("__part", "cluster_id").agg(F.min_by("mz", key).alias("first"), F.max_by("mz", key).alias("last"))
    ends = local.groupBy("__part", "cluster_id").agg(F.max("__i").alias("n")).join(ends, ["__part", "cluster_id"])
    over = Window.partitionBy("cluster_id").orderBy("__part")
    joins = F.coalesce((F.col("first") != F.lag("last").over(over)).cast("int"), F.lit(1))
    before = F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = ends.withColumn("j", joins).select("__part", "cluster_id", (before + F.sum("j").over(over)).alias("__ahead"))
    numbered = local.join(ahead, ["__part", "cluster_id"])
    return numbered.select(*points.columns, (F.col("__ahead") + F.col("__i")).alias("line"))


def write_blocks(peaks: DataFrame, path: str, column: str = "block") -> None:
    """One folder of Parquet for each value of ``column``."""
    peaks.write.partitionBy(column).parquet(path)
