"""Removal of boilerplate lines that spread over many sites.

A HyperLogLog sketch of sites is kept for each line hash and merged by aggregation. Lines whose
estimate lies clearly over ``min_sites`` are boilerplate; those near it, within three standard
errors of the sketch, get an exact distinct count first. Texts are cut into lines once, whose
hashes and places are a table that all of this reads; texts are read again only to be cleaned.

All boilerplate goes. As options, a document that would lose more than ``max_share`` of its
characters is left whole, with ``copies_only`` just where its whole text recurs on another site
(such texts are for document-level deduplication).

Defined cases: lines are compared after trimming ASCII white space; blank lines are never
boilerplate; null text stays null and has no lines; a null site counts as one site of its own;
repeated rows are cleaned alike and all kept; other columns pass through, those named like a
result (whatever the case) with underscores appended, unless their names begin with ``__l_``. No
document is dropped, even if nothing of it is left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions.shared import written
from peakloom.llm.columns import column, own_columns
from peakloom.llm.words import SPACE_CHARS

MIN_SITES, LG_K = 10, 12
RESULTS = ("n_lines", "n_boilerplate", "n_removed")


def _hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def keyed_lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """Each worded line: its document, place, 128-bit hash and site; a written table."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("__l_t"), F.coalesce(F.col(site), F.lit("")).alias("__l_site"), F.posexplode(F.split("text", "\n")).alias("__l_pos", "__l_line"))
    lines = lines.withColumn("__l_line", F.btrim("__l_line", F.lit(SPACE_CHARS))).where("__l_line <> ''")
    a, b = _hashes(F.col("__l_line"))
    return written(lines.select("doc_id", "__l_t", "__l_site", "__l_pos", a.alias("__l_a"), b.alias("__l_b")), "line-hashes")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Hashes (__l_a, __l_b) of the ``keyed_lines`` that occur on at least ``min_sites`` distinct sites."""
    keys = ["__l_a", "__l_b"]
    error = 3 * 1.04 / math.sqrt(2**lg_k)
    low, high = math.floor(min_sites * (1 - error)), math.ceil(min_sites * (1 + error))
    sketches = lines.groupBy(*keys).agg(F.hll_sketch_agg("__l_site", lg_k).alias("s"))
    spread = written(sketches.select(*keys, F.hll_sketch_estimate("s").alias("e")).where(F.col("e") >= low), "line-spread")
    near = spread.where(F.col("e") <= high).select(*keys)
    exact = lines.join(near, keys, "left_semi").groupBy(*keys).agg(F.countDistinct("__l_site").alias("n")).where(F.col("n") >= min_sites).select(*keys)
    return written(spread.where(F.col("e") > high).select(*keys).union(exact), "boilerplate")


def clean_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, max_share: float | None = None, copies_only: bool = False, report: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines taken out of text, plus (if ``report``) n_lines, n_boilerplate and n_removed (long)."""
    lines = keyed_lines(docs, site)
    hits = lines.join(boilerplate(lines, min_sites), ["__l_a", "__l_b"], "left_semi").groupBy(F.col("doc_id").alias("__l_d"), F.col("__l_t").alias("__l_h")).agg(F.collect_set("__l_pos").alias("__l_drop"))
    wide = docs.withColumns({"__l_i": F.col("doc_id"), "__l_t": F.xxhash64("text")})
    wide = wide.join(hits, F.col("__l_i").eqNullSafe(F.col("__l_d")) & (F.col("__l_t") == F.col("__l_h")), "left")
    wide = wide.withColumn("__l_lines", F.split("text", "\n")).withColumn("__l_drop", F.coalesce("__l_drop", F.array().cast("array<int>")))
    cut = F.lit(True)
    if max_share is not None:
        lost = F.aggregate("__l_drop", F.lit(0), lambda acc, i: acc + F.length(F.get(F.col("__l_lines"), i)))
        cut = lost <= max_share * F.length("text")
        if copies_only:
            where = F.coalesce(F.col(site), F.lit(""))
            keys = dict(zip(("__l_a", "__l_b"), _hashes(F.col("text")), strict=True))
            copies = docs.where("text is not null").groupBy(*[k.alias(n) for n, k in keys.items()]).agg(F.min(where).alias("__l_lo"), F.max(where).alias("__l_hi")).where("__l_lo <> __l_hi")
            copies = written(copies.select("__l_a", "__l_b", F.lit(True).alias("__l_copy")), "text-copies")
            wide = wide.join(copies, (keys["__l_a"] == F.col("__l_a")) & (keys["__l_b"] == F.col("__l_b")), "left")
            cut |= F.col("__l_copy").isNull()
    wide = wide.withColumn("__l_cut", cut)
    stays = F.array_except(F.sequence(F.lit(0), F.size("__l_lines") - 1), F.col("__l_drop"))
    cleaned = F.array_join(F.transform(stays, lambda i: F.get(F.col("__l_lines"), i)), "\n")
    n = F.size("__l_drop").cast("long")
    text = F.when(F.col("__l_cut") & (n > 0), cleaned).otherwise(F.col("text"))
    kept = [(text if c == "text" else column(c)).alias(name) for c, name in own_columns(docs, RESULTS if report else ()).items()]
    if not report:
        return wide.select(*kept)
    return wide.select(*kept, F.greatest(F.size("__l_lines"), F.lit(0)).cast("long").alias("n_lines"), n.alias("n_boilerplate"), F.when(F.col("__l_cut"), n).otherwise(F.lit(0)).cast("long").alias("n_removed"))
