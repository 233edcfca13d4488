"""Filtered mzXML documents that keep what filters do not touch, and documents with an index."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions.shared import run_dir, written
from peakloom.operators.preprocess import sample_scans
from peakloom.sources import mzxml_source
from peakloom.sources.mzxml import pack, unpack

#: Attributes of a scan's highest peak, which filters of peaks make wrong.
BASE_PEAK = ("basePeakMz", "basePeakIntensity")
_END = re.compile(r"</scan\s*>")


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    mzxml_source.register(spark)
    return spark.read.format("mzxml").options(**options).load(path)


def _escaped(text: Column) -> Column:
    for plain, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(plain), F.lit(by))
    return text


def _tag(name: str, attributes: Column, changed: dict[str, Column], dropped: tuple[str, ...] = ()) -> Column:
    """A start tag with ``attributes`` in their order, some with other values; those that are not there come last."""
    entries = F.filter(F.coalesce(F.map_entries(attributes), F.array().cast("array<struct<key:string,value:string>>")), lambda e: ~e.key.isin(*dropped)) if dropped else F.coalesce(F.map_entries(attributes), F.array().cast("array<struct<key:string,value:string>>"))

    def value(e: Column) -> Column:
        out = e.value
        for k, v in changed.items():
            out = F.when(e.key == k, v).otherwise(out)
        return out

    known = F.coalesce(F.map_keys(attributes), F.array().cast("array<string>"))
    one = lambda k, v: F.concat(F.lit(" "), k, F.lit('="'), _escaped(v), F.lit('"'))
    more = [F.when(F.array_contains(known, k), F.lit("")).otherwise(one(F.lit(k), v)) for k, v in changed.items()]
    return F.concat(F.lit(f"<{name}"), F.concat_ws("", F.transform(entries, lambda e: one(e.key, value(e)))), *more, F.lit(">"))


def _repacked(mz: tuple[float, float | None], least: float, compression: str):
    """Peak lists with the peaks strictly inside the bounds: text, bytes ahead of compression and number of peaks."""

    @F.arrow_udf("text string, size int, n int")
    def run(text: pa.Array, precision: pa.Array, how: pa.Array) -> pa.Array:
        rows = []
        for t, p, c in zip(text.to_pylist(), precision.to_pylist(), how.to_pylist(), strict=True):
            pairs = unpack(t, p, c)
            keep = (pairs[:, 1] > least) & (pairs[:, 0] > mz[0]) & ((pairs[:, 0] < mz[1]) if mz[1] is not None else np.True_)
            done, size = pack(pairs[keep], p, compression)
            rows.append({"text": done, "size": size, "n": int(keep.sum())})
        return pa.array(rows, pa.struct([("text", pa.string()), ("size", pa.int32()), ("n", pa.int32())]))

    return run


def _pop(stack: list[bool], below: int, closing: str) -> tuple[int, str]:
    """End tags of ``closing`` pop ``stack``; those of scans that go are left out. Beyond the stack, ``below`` counts and the tag stays undecided (kept)."""
    out, at = [], 0
    for m in _END.finditer(closing):
        kept = True
        if stack:
            kept = stack.pop()
        else:
            below += 1
        out.append(closing[at : m.start()] + (m[0] if kept else ""))
        at = m.end()
    return below, "".join(out) + closing[at:]


def with_closings(scans: DataFrame) -> DataFrame:
    """``scans`` (at, closing, kept: all scans of one document) with the end tags in ``closing`` that belong to scans which are kept.

    An end tag is that of the scan which is open where it stands. Ranges of scans first tell how many
    scans of earlier ranges they end, and which of their own they leave open; folded in order, a row
    a range, this gives each range the scans that are open ahead of it.
    """
    placed = written(scans.repartitionByRange("at").sortWithinPartitions("at").withColumn("__part", F.spark_partition_id()), "scans-in-order")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stacks: dict[int, tuple[int, list[bool]]] = {}
        for batch in batches:
            for part, closing, kept in zip(*(batch[c].to_pylist() for c in ("__part", "closing", "kept")), strict=True):
                below, stack = stacks.get(part, (0, []))
                stack.append(kept)
                stacks[part] = (_pop(stack, below, closing)[0], stack)
        yield pa.RecordBatch.from_pylist([{"part": p, "below": b, "stack": s} for p, (b, s) in stacks.items()], pa.schema([("part", pa.int32()), ("below", pa.int32()), ("stack", pa.list_(pa.bool_()))]))

    in_order = placed.repartition("__part").sortWithinPartitions("__part", "at")
    ahead, stack = {}, []
    for r in sorted(in_order.mapInArrow(told, "part int, below int, stack array<boolean>").collect(), key=lambda r: r.part):
        ahead[r.part] = stack
        if r.below > len(stack):
            raise ValueError("the document has end tags of scans that did not begin")
        stack = stack[: len(stack) - r.below] + r.stack
    known = scans.sparkSession.sparkContext.broadcast(ahead)

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stacks: dict[int, list[bool]] = {}
        for batch in batches:
            out = []
            for part, closing, kept in zip(*(batch[c].to_pylist() for c in ("__part", "closing", "kept")), strict=True):
                own = stacks.setdefault(part, list(known.value.get(part, [])))
                own.append(kept)
                out.append(_pop(own, 0, closing)[1])
            yield pa.RecordBatch.from_arrays([batch["at"], pa.array(out, pa.string()), batch["kept"], batch["new_num"]], ["at", "closing", "kept", "new_num"])

    return in_order.mapInArrow(closed, "at long, closing string, kept boolean, new_num int")


def _tail(tail: str) -> str:
    """``tail`` without checksums, its index offset nil."""
    tail = re.sub(r"<sha1(?=[\s>/]).*?(?:</sha1\s*>|/>)", "", tail, flags=re.DOTALL)
    return re.sub(r'<indexOffset(?:\s[^>]*?)?(?:/>|>.*?</indexOffset\s*>)', '<indexOffset xsi:nil="1"></indexOffset>', tail, flags=re.DOTALL)


def _coded(text: str) -> str:
    return base64.b64encode(text.encode()).decode()


def rewrite(
    spark: SparkSession, path: str, out: str, scan_type: str = "Full", take: str = "all", rt: tuple[float, float] | None = None, num: tuple[int, int] | None = None,
    mz: tuple[float, float | None] = (0.0, None), min_intensity: float = 0.0, compress: bool = True, renumber: bool = True,
) -> None:
    """The document at ``path`` with the scans and peaks that filters leave, as a document of parts at ``out``.

    Everything else stays: elements and attributes of the head, of scans and of the tail, nesting, white
    space. ``sha1`` and ``index`` go, the index offset becomes nil, attributes of the base peak go, and
    num (if ``renumber``), peaksCount, the peaks' compression, and the run's number of scans and times
    are set. A scan whose parent goes stands in the next scan around it that stays.
    """
    thin = written(read(spark, path, texts="false").select("at", "num", "scan_type", "rt", "closing"), "scans-of-document")
    kept = written(sample_scans(thin.drop("closing"), scan_type, take, rt, num, renumber, order="at").select("at", F.col("new_num").cast("int").alias("new_num")), "kept-scans")
    marked = thin.select("at", "closing").join(kept, "at", "left").withColumn("kept", F.col("new_num").isNotNull())
    places = written(with_closings(marked), "closings")
    ends = places.where(~F.col("kept") & F.col("closing").rlike("</scan")).select("at", F.regexp_replace("closing", r"^\s+", "").alias("value"), F.lit(0).alias("scans"), F.lit(None).cast("double").alias("rt"), F.lit(None).cast("string").alias("rt_text"))
    own = read(spark, path).where(F.col("scan_type") == scan_type).drop("closing").join(places.where("kept"), "at")
    new = _repacked(mz, min_intensity, "zlib" if compress else "none")(F.coalesce("peaks._VALUE", F.lit("")), F.coalesce("peaks._precision", F.lit(32)), F.coalesce("peaks._compressionType", F.lit("none")))
    own = own.withColumn("new", new)
    of_peaks = {"compressionType": F.lit("zlib" if compress else "none"), "compressedLen": F.col("new.size").cast("string")}
    element = F.when(F.col("peaks").isNull(), F.lit("")).otherwise(F.concat(_tag("peaks", F.col("peaks_attributes"), of_peaks), F.col("new.text"), F.lit("</peaks>")))
    opening = _tag("scan", F.col("attributes"), {"num": F.col("new_num").cast("string"), "peaksCount": F.col("new.n").cast("string")}, BASE_PEAK)
    body = F.concat(opening, "before", element, "after", "closing")
    rows = own.select("at", body.alias("value"), F.lit(1).alias("scans"), "rt", "rt_text").unionByName(ends)
    head, tail = mzxml_source.head_and_tail(path)
    ordered = rows.repartitionByRange("at").sortWithinPartitions("at").select("value", "scans", "rt", "rt_text")
    ordered.write.format("mzxml").option("head", _coded(_head(head))).option("tail", _coded(_tail(tail))).mode("overwrite").save(out)


def _head(head: str) -> str:
    return re.sub(r"<sha1(?=[\s>/]).*?(?:</sha1\s*>|/>)", "", head, flags=re.DOTALL)


def add_index(spark: SparkSession, path: str) -> None:
    """Give a document of parts an index of its scans: parts of offsets ahead of the end of its last part."""
    system, folder = mzxml_source.opened(path)
    parts = sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.is_file and f.base_name.startswith("part-"))
    with system.open_input_file(parts[-1]) as f:
        tail = f.read().decode()
    before, rest = tail.split("<indexOffset", 1)
    place = sum(f.size for f in system.get_file_info(parts[:-1])) + len(before.encode())
    lines = run_dir(spark, "index-lines")
    entry = F.concat(F.lit('<offset id="'), F.col("num"), F.lit('">'), F.col("at"), F.lit("</offset>"))
    read(spark, path, texts="false").where("num is not null").select("at", "num").repartitionByRange("at").sortWithinPartitions("at").select(entry.alias("value")).write.text(lines)
    own, at = mzxml_source.opened(lines)
    stem = parts[-1].removesuffix(".mzXML")
    with system.open_output_stream(f"{stem}-0.mzXML") as out:
        out.write(f'{before}<index name="scan">\n'.encode())
    for k, f in enumerate(sorted((f for f in own.get_file_info(fs.FileSelector(at)) if f.base_name.startswith("part-")), key=lambda f: f.path)):
        fs.copy_files(f.path, f"{stem}-1-{k:06d}.mzXML", source_filesystem=own, destination_filesystem=system)
    with system.open_output_stream(f"{stem}-2.mzXML") as out:
        out.write(f"</index>\n<indexOffset>{place}</indexOffset>{rest.split('</indexOffset>', 1)[1]}".encode())
    system.delete_file(parts[-1])
