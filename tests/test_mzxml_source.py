"""The mzXML data source: splits, pushed filters, look-ups by index, documents kept by a rewrite, commits."""

import contextlib
import re
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.sources import mzxml, mzxml_rewrite, mzxml_source

HEAD = """<?xml version="1.0" encoding="ISO-8859-1"?>
<mzXML xmlns="http://sashimi.sourceforge.net/schema_revision/mzXML_3.1" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">
 <msRun scanCount="{n}"
        endTime="PT9M"
        startTime = 'PT0S'>
  <parentFile fileName="a &lt;b&gt;.raw" fileType="RAWData" fileSha1="00ff"/>
  <msInstrument msInstrumentID="1"><msManufacturer category="msManufacturer" value="Zürich &amp; Co"/>
   <operator first="A" last="B"/></msInstrument>
  <dataProcessing centroided="1"><software type="conversion" name="x" version="1"/><processingOperation name="y" value="&quot;z&quot;"/></dataProcessing>
"""
TAIL = """
  <sha1>cafe</sha1>
 </msRun>
 {index}
 <sha1>0123</sha1>
</mzXML>
"""


def peaks_of(num, n):
    rng = np.random.default_rng(num)
    return np.stack([np.sort(rng.uniform(100, 900, n)), np.round(rng.uniform(0, 50, n), 1)], 1)


def scan_text(num, inner="", kind="Full", n=None, precision=None, end=True):
    pairs = peaks_of(num, num % 7 + 1 if n is None else n)
    precision, how = precision or (32, 64)[num % 2], ("zlib", "none")[num % 3 == 0]
    text, size = mzxml.pack(pairs, precision, how)
    length = f' compressedLen="{size}"' if num % 5 else ""
    parent = f'<precursorMz precursorIntensity="{num}.5" activationMethod="CID">{400 + num}.25</precursorMz>\n' if kind != "Full" else ""
    tag = f"""<scan num="{num}" msLevel="{2 if parent else 1}" peaksCount="{len(pairs)}" scanType="{kind}" basePeakMz="1" basePeakIntensity="2"
   retentionTime="PT{num}.50S" note='say "hi" &amp; &#x41;'>{parent}
   <peaks precision="{precision}" byteOrder="network" contentType="m/z-int" compressionType="{how}"{length}>{text}</peaks>
   <nameValue name="scanned" value="{num}"/>{inner}"""
    return tag + ("</scan>\n  " if end else "")


def document(tops=8, index=None, scans=None):
    """``tops`` scans with others in them, one of them three levels deep and one without content."""
    if scans is None:
        scans, num = [], 1
        for k in range(tops):
            own, inner = num, ""
            for _ in range(k % 3):
                num += 1
                inner += scan_text(num, kind="MS2" if num % 4 else "Full")
            if k == 5:
                num += 2
                inner += scan_text(num - 1, scan_text(num, kind="Full"), kind="MS2")
            scans.append(scan_text(own, inner))
            num += 1
        scans.append(f'<scan num="{num}" scanType="Full" retentionTime="PT{num}S" peaksCount="0"/>')
    body = "".join(scans)
    head = HEAD.format(n=len(re.findall(r"<scan\s", body)))
    text = head + body
    if index is None:
        return text + TAIL.format(index="<indexOffset>0</indexOffset>")
    entries = "".join(f'<offset id="{m[1]}">{len(text[: m.start()].encode("latin-1")) + index}</offset>\n' for m in re.finditer(r'<scan num="(\d+)"', text))
    at = len((text + TAIL.split("{index}")[0]).encode("latin-1"))
    return text + TAIL.format(index=f'<index name="scan">\n{entries}</index>\n <indexOffset>{at}</indexOffset>')


def save(path, text):
    path.write_bytes(text.encode("latin-1"))
    return str(path)


def rows(df):
    return df.orderBy("document", "at").collect()


def scan_lists(spark, path):
    return {r.num: [tuple(p) for p in r.peaks] for r in mzxml.decode_scans(mzxml_rewrite.read(spark, path)).collect()}


def test_rows_are_those_of_the_other_reader_for_any_split(spark, tmp_path, monkeypatch):
    path = save(tmp_path / "a.mzXML", document())
    want = {r.num: r for r in mzxml.decode_scans(mzxml.read_scans(spark, path)).collect()}
    whole = rows(mzxml_rewrite.read(spark, path))
    assert [r.num for r in whole] == sorted(want) and all(r.rt == want[r.num].rt and r.scan_type == want[r.num].scan_type and r.peaks_count == want[r.num].peaks_count for r in whole)
    assert all(lists == [tuple(p) for p in want[num].peaks or []] for num, lists in scan_lists(spark, path).items())
    assert whole[0].attributes["note"] == 'say "hi" & A' and "precursorMz" in next(r.before for r in whole if r.scan_type == "MS2") and "nameValue" in whole[0].after
    text = document()
    rebuilt = text[: whole[0].at]
    for k, r in enumerate(whole):
        rebuilt += text[r.at : whole[k + 1].at if k + 1 < len(whole) else None]
    assert rebuilt == text
    for chunk in (7, 64, 1000):
        with contextlib.closing(mzxml_source.Joined(*mzxml_source.opened(path))) as f:
            found = [s for k in range(0, f.size, 97) for s in mzxml_source.segments(f, k, k + 97, chunk)]
        assert [s.at for s in found] == [r.at for r in whole] and b"".join(s.data for s in found).decode("latin-1") == text[whole[0].at :]
    for split in (50, 333, 5000):
        assert rows(mzxml_rewrite.read(spark, path, splitBytes=split)) == whole
    assert mzxml_rewrite.read(spark, path, splitBytes=500).rdd.getNumPartitions() > 10


def test_filters_are_in_the_plan_and_hold(spark, tmp_path):
    path = save(tmp_path / "a.mzXML", document())
    df = mzxml_rewrite.read(spark, path).where("scan_type = 'MS2' and rt >= 3 and num in (3, 6, 8, 9, 12)").where(F.length("document") > 0)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [" in plan and "Condition : (isnotnull(document" in plan and "EqualTo(scan_type,MS2)" in plan.replace(" ", "") and re.search(r"In\(num", plan.replace(" ", ""))
    everything = mzxml_rewrite.read(spark, path).collect()
    assert sorted(r.num for r in df.collect()) == sorted(r.num for r in everything if r.scan_type == "MS2" and r.rt >= 3 and r.num in (3, 6, 8, 9, 12))
    for condition, test in (("num > 4 and num <= 7", lambda r: 4 < r.num <= 7), ("rt < 5.5", lambda r: r.rt < 5.5), ("peaks_count = 0", lambda r: r.peaks_count == 0), ("num is null", lambda r: False), ("not num = 3", lambda r: r.num != 3), ("rt = 3.5 or num = 9", lambda r: r.rt == 3.5 or r.num == 9)):
        assert sorted(r.num for r in mzxml_rewrite.read(spark, path).where(condition).collect()) == sorted(r.num for r in everything if test(r)), condition
    assert {r.before for r in mzxml_rewrite.read(spark, path, texts="false").collect()} == {None}


def test_look_up_reads_little_and_does_not_trust_a_broken_index(spark, tmp_path):
    scans = [scan_text(i, n=300) for i in range(1, 2500)]
    good = save(tmp_path / "good.mzXML", document(index=0, scans=scans))
    shifted = save(tmp_path / "shifted.mzXML", document(index=3, scans=scans))
    nums = [1, 17, 400, 401, 999, 1500, 2000, 2200, 2498, 2499]

    def read(path, wanted):
        with contextlib.closing(mzxml_source.Joined(*mzxml_source.opened(path))) as f:
            found = mzxml_source.looked_up(f, wanted, [("in", "num", set(wanted))])
            return found and [r["num"] for r in found], f.bytes_read / f.size

    found, share = read(good, nums)
    assert found == nums and share < 0.05
    assert read(good, [5, 9999])[0] == [5]  # complete by the head's count, so 9999 is nowhere
    assert read(shifted, nums)[0] is None
    short = save(tmp_path / "short.mzXML", document(index=0, scans=scans).replace('<offset id="17">', '<offset idx="17">'))
    assert read(short, nums)[0] is None
    for path in (good, shifted, short):
        df = mzxml_rewrite.read(spark, path).where(F.col("num").isin(nums))
        assert sorted(r.num for r in df.collect()) == nums
    want = {r.num: r for r in mzxml_rewrite.read(spark, good, index="false").where(F.col("num").isin(nums)).collect()}
    assert {r.num: r for r in mzxml_rewrite.read(spark, good).where(F.col("num").isin(nums)).collect()} == want
    assert mzxml_rewrite.read(spark, good).where("num = 17").rdd.getNumPartitions() == 1


def test_run_header_over_several_lines(spark, tmp_path):
    path = save(tmp_path / "a.mzXML", document())
    assert [tuple(r) for r in mzxml.read_run(spark, path).collect()] == [(len(re.findall(r"<scan\s", document())), "PT0S", "PT9M")]


def tree(text, skip=("num", "peaksCount", "scanCount", "startTime", "endTime", "basePeakMz", "basePeakIntensity")):
    """A document's elements without what a rewrite may change."""

    def of(e):
        name = e.tag.split("}")[-1]
        attributes = {k.split("}")[-1]: v for k, v in e.attrib.items() if k not in skip and not (name == "peaks" and k.startswith("compress")) and name != "indexOffset"}
        return name, attributes, "" if name in ("peaks", "indexOffset") else (e.text or "").strip(), [of(c) for c in e if c.tag.split("}")[-1] not in ("sha1", "index")]

    return of(ET.fromstring(text))


def joined(folder):
    return b"".join(p.read_bytes() for p in sorted(folder.glob("part-*")))


def only(node, keep):
    """``tree`` with the scans whose name value is in ``keep``; children of others stand where those stood."""
    name, attributes, text, children = node
    out = []
    for c in children:
        c = only(c, keep)
        if c[0] == "scan" and not ({x[1].get("value") for x in c[3] if x[0] == "nameValue"} & keep):
            out += [x for x in c[3] if x[0] == "scan"]
        else:
            out.append(c)
    return name, attributes, text, out


def test_rewrite_keeps_the_document(spark, tmp_path):
    text = re.sub(r'<scan num="\d+" scanType="Full" retentionTime="PT\d+S" peaksCount="0"/>', "", document(index=0))
    path = save(tmp_path / "a.mzXML", text.replace('scanType="MS2"', 'scanType="Full"'))
    mzxml_rewrite.rewrite(spark, path, f"file://{tmp_path}/out")
    done = joined(tmp_path / "out")
    assert tree(done) == tree(text.replace('scanType="MS2"', 'scanType="Full"').encode("latin-1"))
    assert b"<sha1>" not in done and b"<index " not in done and b'<indexOffset xsi:nil="1"></indexOffset>' in done and b"basePeak" not in done and "Zürich".encode("latin-1") in done and b"fileSha1" in done
    before, after = scan_lists(spark, path), scan_lists(spark, str(tmp_path / "out"))
    assert {k: [p for p in v if p[1] > 0] for k, v in before.items()} == after
    n = len(before)
    assert f'scanCount="{n}"'.encode() in done and b'startTime="PT1.50S"' in done and f'endTime="PT{n}.50S"'.encode() in done
    assert mzxml_rewrite.read(spark, str(tmp_path / "out")).select("peaks._compressionType").distinct().collect() == [("zlib",)]


@pytest.mark.parametrize("options", [{}, {"take": "even"}, {"take": "odd", "rt": (3.0, 12.0), "renumber": False}, {"scan_type": "MS2"}, {"num": (4, 11), "mz": (200.0, 700.0), "min_intensity": 10.0, "compress": False}, {"scan_type": "none"}])
def test_rewrite_filters_scans_and_keeps_nesting(spark, tmp_path, options):
    text = document()
    path = save(tmp_path / "a.mzXML", text)
    mzxml_rewrite.rewrite(spark, path, f"file://{tmp_path}/out", **options)
    nums = sorted(int(n) for n in re.findall(r'<scan num="(\d+)"', text))
    kinds = dict(re.findall(r'<scan num="(\d+)"[^>]*?scanType="(\w+)"', text))
    kept = [n for n in nums if kinds[str(n)] == options.get("scan_type", "Full")]
    kept = kept[{"even": 1, "odd": 0}[options["take"]] :: 2] if "take" in options else kept
    lo, hi = options.get("rt", (0, 1e9))
    a, b = options.get("num", (0, 1e9))
    kept = [n for n in kept if lo <= n + (0.5 if n < nums[-1] else 0) <= hi and a <= n <= b]
    done = joined(tmp_path / "out")
    last = nums[-1] in kept
    want = only(tree(text.encode("latin-1")), {str(n) for n in kept})
    if last:  # the scan without content has no name value
        run = next(c for c in want[3] if c[0] == "msRun")
        run[3].append(("scan", {"scanType": "Full", "retentionTime": f"PT{nums[-1]}S"}, "", []))
    assert tree(done) == want
    out = [int(n) for n in re.findall(rb'<scan num="(\d+)"', done)]
    assert out == (kept if options.get("renumber") is False else list(range(1, len(kept) + 1))) and f'scanCount="{len(kept)}"'.encode() in done
    mz, least = options.get("mz", (0.0, None)), options.get("min_intensity", 0.0)
    before = scan_lists(spark, path)
    want = [[p for p in before[n] or [] if p[1] > least and p[0] > mz[0] and (mz[1] is None or p[0] < mz[1])] for n in kept]
    after = scan_lists(spark, str(tmp_path / "out"))
    assert [after[n] for n in out] == want


def test_closings_over_many_ranges(spark):
    """Deep nesting whose end tags are far from their start tags, in as many ranges as there are partitions."""
    rng, rows_, depth = np.random.default_rng(3), [], 0
    for i in range(400):
        ends = int(rng.integers(0, depth + 2)) if i < 399 else depth + 1
        depth += 1 - ends
        rows_.append((i * 10, "</scan> " * ends, bool(rng.random() < 0.6), i))
    got = {r.at: r.closing for r in mzxml_rewrite.with_closings(spark.createDataFrame(rows_, "at long, closing string, kept boolean, new_num int").repartition(4)).collect()}
    stack = []
    for at, closing, kept, _ in rows_:
        stack.append(kept)
        assert got[at].count("</scan>") == sum(stack.pop() for _ in range(closing.count("</scan>")))
    with pytest.raises(ValueError, match="did not begin"):
        mzxml_rewrite.with_closings(spark.createDataFrame([(0, "</scan></scan>", True, 1)], "at long, closing string, kept boolean, new_num int"))


def test_documents_of_parts_with_an_index(spark, tmp_path):
    path = save(tmp_path / "a.mzXML", document(tops=40))
    out = str(tmp_path / "out")
    mzxml_rewrite.rewrite(spark, path, f"file://{out}")
    plain = {r.num: (r.rt, r.before, r.after, r.peaks) for r in mzxml_rewrite.read(spark, out).collect()}
    mzxml_rewrite.add_index(spark, out)
    df = mzxml_rewrite.read(spark, out).where("num in (3, 20)")
    assert df.rdd.getNumPartitions() == 1 and {r.num: (r.rt, r.before, r.after, r.peaks) for r in df.collect()} == {k: plain[k] for k in (3, 20)}
    with contextlib.closing(mzxml_source.Joined(*mzxml_source.opened(out))) as f:
        assert sorted(mzxml_source.index_of(f)) == sorted(plain)
    assert ET.fromstring(joined(tmp_path / "out")) is not None and len(rows(mzxml_rewrite.read(spark, out))) == len(plain)


def test_a_lost_task_leaves_no_part(spark, tmp_path):
    out = tmp_path / "out"
    head, tail = mzxml_rewrite._coded("<mzXML><msRun>"), mzxml_rewrite._coded("</msRun></mzXML>")
    df = spark.range(0, 40, 1, 4).select(F.concat(F.lit('<scan num="'), "id", F.lit('"></scan>')).alias("value"), F.lit(1).alias("scans"), F.col("id").cast("double").alias("rt"), F.concat(F.lit("PT"), "id", F.lit("S")).alias("rt_text"))
    mzxml_source.register(spark)
    write = lambda df, mode: df.write.format("mzxml").option("head", head).option("tail", tail).mode(mode).save(f"file://{out}")
    write(df, "append")
    first = joined(out)
    assert b'<msRun scanCount="40" startTime="PT0S" endTime="PT39S">' in first and [int(x) for x in re.findall(rb'num="(\d+)"', first)] == list(range(40))
    broken = df.withColumn("value", F.when(F.col("rt") == 35, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        write(broken, "overwrite")
    assert joined(out) == first and not list(out.glob("_writing*"))
    with pytest.raises(Exception, match="cannot be appended"):
        write(df, "append")
    assert joined(out) == first and not list(out.glob("_writing*"))
    write(df.where("rt < 5"), "overwrite")
    assert b'scanCount="5"' in joined(out)
    with pytest.raises(Exception, match="nowhere"):
        mzxml_rewrite.read(spark, str(tmp_path / "nowhere")).collect()
