"""mzXML documents: scans, their base64 peak lists, and the run header."""

from __future__ import annotations

import base64
import re
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.functions.scalars import duration_seconds
from peakloom.functions.shared import written
from peakloom.operators.preprocess import run_header

#: Levels of scans inside scans that are read; deeper ones are an error.
DEPTH = 6
#: Further attributes of scans, which are carried over. Those of the base peak are not, since filters change it.
CARRIED = ("msLevel", "polarity", "filterLine", "centroided", "deisotoped", "chargeDeconvoluted", "startMz", "endMz", "lowMz", "highMz", "totIonCurrent", "collisionEnergy", "ionisationEnergy", "cidGasPressure")
_PEAKS = T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_precision", T.IntegerType()), T.StructField("_compressionType", T.StringType()), T.StructField("_compressedLen", T.IntegerType())])
_FIELDS = [
    T.StructField("_num", T.IntegerType()), T.StructField("_scanType", T.StringType()), T.StructField("_retentionTime", T.StringType()),
    T.StructField("_peaksCount", T.IntegerType()), *[T.StructField(f"_{a}", T.StringType()) for a in CARRIED], T.StructField("peaks", _PEAKS),
]
_NAMES = [f.name for f in _FIELDS]


def _schema(depth: int) -> T.StructType:
    inner = T.StringType() if depth == 1 else _schema(depth - 1)
    return T.StructType([*_FIELDS, T.StructField("scan", T.ArrayType(inner))])


SCHEMA = _schema(DEPTH)
_LISTS = pa.list_(pa.struct([("mz", pa.float64()), ("intensity", pa.float64())]))
#: Bytes of a batch of scans that goes to Python.
BATCH_BYTES = 4 << 20
PAIRS = T.ArrayType(T.StructType([T.StructField("mz", T.DoubleType()), T.StructField("intensity", T.DoubleType())]))


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """num, scan_type, rt, rt_text, peaks_count, attributes, doc_order and peaks (still text) of all scans, those inside other scans included.

    doc_order (an array) sorts scans as they stand in a document. A document of parts is read by the
    data source, at any depth: its files are no XML one by one.
    """
    if any(f.rsplit("/", 1)[-1].startswith("part-") for f in spark.read.text(path).inputFiles()):
        return _of_parts(spark, path)
    level = spark.read.format("xml").option("rowTag", "scan").schema(SCHEMA).load(path)
    level = level.select(F.array(F.monotonically_increasing_id()).alias("doc_order"), F.struct(*level.columns).alias("s"))
    levels = []
    for depth in range(DEPTH):
        levels.append(level.select("doc_order", *[F.col(f"s.{n}").alias(n) for n in _NAMES]))
        inner = level.select("doc_order", F.posexplode("s.scan").alias("__p", "s"))
        level = inner.select(F.concat("doc_order", F.array(F.col("__p").cast("long"))).alias("doc_order"), "s")
    deeper = F.raise_error(F.concat(F.lit(f"scans are nested deeper than {DEPTH} levels: "), F.substring(F.col("s").cast("string"), 1, 80)))
    levels.append(level.where(deeper.isNotNull()).select("doc_order", *[F.lit(None).cast(f.dataType).alias(f.name) for f in _FIELDS]))
    flat = reduce(DataFrame.unionByName, levels)
    return flat.select(
        F.col("_num").alias("num"), F.col("_scanType").alias("scan_type"), duration_seconds(F.col("_retentionTime")).alias("rt"), F.col("_retentionTime").alias("rt_text"),
        F.col("_peaksCount").alias("peaks_count"), F.struct(*[F.col(f"_{a}").alias(a) for a in CARRIED]).alias("attributes"), "doc_order", "peaks",
    )


def _of_parts(spark: SparkSession, path: str) -> DataFrame:
    from peakloom.sources import mzxml_source

    mzxml_source.register(spark)
    attributes = F.struct(*[F.col("attributes")[a].alias(a) for a in CARRIED])
    rows = spark.read.format("mzxml").load(path).withColumn("doc_order", F.array(F.monotonically_increasing_id()))
    return rows.select("num", "scan_type", "rt", "rt_text", "peaks_count", attributes.alias("attributes"), "doc_order", "peaks")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """scan_count, start_time and end_time of the runs at ``path``, as their headers say."""
    tags = spark.read.option("lineSep", ">").text(path).where(F.col("value").contains("<msRun"))  # a tag may go over several lines
    said = lambda name: F.regexp_extract("value", rf"""<msRun\b[^<]*\s{name}\s*=\s*["']([^"']*)""", 1)
    return tags.select(said("scanCount").cast("long").alias("scan_count"), said("startTime").alias("start_time"), said("endTime").alias("end_time"))


def small_batches(df: DataFrame) -> None:
    """Peak lists are long rows: the session's batches to and from Python hold BATCH_BYTES at most, or a row."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unpack(text: str | None, precision: int, compression: str | None) -> np.ndarray:
    """(n, 2) of mz and intensity. Characters outside the alphabet are skipped, and the stated compressed length is not needed."""
    data = base64.b64decode(re.sub(r"[^A-Za-z0-9+/=]", "", text or ""))
    data = zlib.decompress(data) if compression == "zlib" and data else data
    width = {32: 4, 64: 8}[precision]
    if len(data) % (2 * width):
        raise ValueError("peak list does not hold whole pairs")
    return np.frombuffer(data, f">f{width}").astype(np.float64).reshape(-1, 2)


def pack(pairs: np.ndarray, precision: int, compression: str | None) -> tuple[str, int]:
    """Text of a peak list, and its length in bytes ahead of compression."""
    plain = np.asarray(pairs, np.float64).reshape(-1, 2).astype(f">f{precision // 8}").tobytes()
    return base64.b64encode(zlib.compress(plain) if compression == "zlib" else plain).decode(), len(plain)


@F.arrow_udf(PAIRS)
def decode(text: pa.Array, precision: pa.Array, compression: pa.Array) -> pa.Array:
    done = [_listed(unpack(t.as_py(), p.as_py(), c.as_py())) for t, p, c in zip(text, precision, compression, strict=True)]  # a text at a time
    return pa.concat_arrays(done) if done else pa.array([], _LISTS)


def _listed(pairs: np.ndarray) -> pa.Array:
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["mz", "intensity"])
    return pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), points)


def decode_scans(scans: DataFrame) -> DataFrame:
    """``scans`` with peaks as an array of (mz, intensity). Filter scans first: this is the one step in Python."""
    small_batches(scans)
    lists = F.coalesce("peaks._VALUE", F.lit("")), F.coalesce("peaks._precision", F.lit(32)), F.coalesce("peaks._compressionType", F.lit("none"))
    return scans.withColumn("peaks", decode(*lists))


def explode_peaks(scans: DataFrame) -> DataFrame:
    """scan_num, rt, pos, mz, intensity of decoded scans."""
    return scans.select(F.col("num").alias("scan_num"), "rt", F.posexplode("peaks").alias("pos", "p")).select("scan_num", "rt", "pos", "p.mz", "p.intensity")


def encode(pairs: Column, precision: int = 32, compression: str = "zlib") -> Column:
    """Peak lists (arrays of mz and intensity) as the struct of an element ``peaks``."""

    @F.arrow_udf("text string, size int")
    def packed(lists: pa.Array) -> pa.Array:
        points, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
        mz, intensity = (points.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        done = [pack(np.stack([mz[i:j], intensity[i:j]], 1), precision, compression) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], ["text", "size"])

    x = packed(pairs)
    return F.struct(x["text"].alias("_VALUE"), F.lit(precision).alias("_precision"), F.lit(compression).alias("_compressionType"), x["size"].alias("_compressedLen"))


def encode_scans(peaks: DataFrame, precision: int = 32, compression: str = "zlib", scan_type: str = "Full") -> DataFrame:
    """Rows like those of ``read_scans`` (attributes and doc_order left out), of peaks (scan_num, rt, mz, intensity), in mz order inside a scan."""
    small_batches(peaks)
    lists = peaks.groupBy("scan_num", "rt").agg(F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("pairs"))
    time = F.concat(F.lit("PT"), F.col("rt").cast("decimal(20,6)").cast("string"), F.lit("S"))
    return lists.select(F.col("scan_num").cast("int").alias("num"), F.lit(scan_type).alias("scan_type"), "rt", time.alias("rt_text"), F.size("pairs").alias("peaks_count"), encode(F.col("pairs"), precision, compression).alias("peaks"))


def _escaped(text: Column) -> Column:
    for plain, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(by))
    return text


def _attribute(name: str, value: Column) -> Column:
    """`` name="value"``, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), _escaped(value.cast("string")), F.lit('"')), F.lit(""))


def write_mzxml(scans: DataFrame, path: str, renumber: bool = True, one_file: bool = False) -> None:
    """An mzXML document of rows like those of ``read_scans``, their attributes carried over, as lines of text below ``path``.

    The files in their order, or ``one_file``, are the document: header with the number of scans and
    the original texts of the least and greatest time, a line for each scan in order of num (anew
    from 1 if ``renumber``), a nil index offset, no checksum. Scans that stood in others stand beside them.
    """
    from peakloom.functions.ranking import ordinals

    scans = written(scans, "scans-to-write")
    head = run_header(scans)
    if renumber:
        places = ordinals(scans, "num", "__place")
        scans = scans.join(places, "num").withColumn("num", F.col("__place") + 1).drop("__place")
    carried = [_attribute(a, F.col(f"attributes.{a}")) for a in CARRIED] if "attributes" in scans.columns else []
    own = {"num": "num", "scanType": "scan_type", "peaksCount": "peaks_count", "retentionTime": "rt_text"}
    inner = {"precision": "peaks._precision", "byteOrder": None, "contentType": None, "compressionType": "peaks._compressionType", "compressedLen": "peaks._compressedLen"}
    fixed = {"byteOrder": "network", "contentType": "m/z-int"}
    body = F.concat(F.lit("<scan"), *[_attribute(k, F.col(c)) for k, c in own.items()], *carried, F.lit("><peaks"), *[_attribute(k, F.col(c) if c else F.lit(fixed[k])) for k, c in inner.items()], F.lit(">"), F.coalesce("peaks._VALUE", F.lit("")), F.lit("</peaks></scan>"))
    lines = scans.select(F.col("num").cast("long").alias("__at"), body.alias("value"))
    opening = F.concat(F.lit('<?xml version="1.0" encoding="ISO-8859-1"?>\n<mzXML xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">\n<msRun'), _attribute("scanCount", F.col("scan_count")), _attribute("startTime", F.col("start_time")), _attribute("endTime", F.col("end_time")), F.lit(">"))
    first = head.select(F.lit(-(1 << 62)).alias("__at"), opening.alias("value"))
    last = head.select(F.lit(1 << 62).alias("__at"), F.lit('</msRun>\n<indexOffset xsi:nil="1"></indexOffset>\n</mzXML>').alias("value"))
    ordered = lines.union(first).union(last)
    ordered = ordered.coalesce(1) if one_file else ordered.repartitionByRange("__at")
    ordered.sortWithinPartitions("__at").select("value").write.text(path)
