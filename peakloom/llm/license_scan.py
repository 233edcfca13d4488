"""Licence scan by canonical digest lookup.

Texts are brought to a canonical form (copyright lines out, lower case, punctuation to spaces,
equivalent spellings made one) and their SHA-256 digests are joined to those of known licences.
``whole_texts`` does so for documents; ``scan`` takes each line for an entire text, too, so that a
document that is a licence and a document that carries a notice line are both found. Known are the
texts of ``license_texts`` (seven whole licences and short notices) or those of a folder, and the digests
of longer licences as their publishers distribute them (Apache, GPL, LGPL, MPL and others).

Defined cases: null and empty texts, and texts of punctuation or copyright lines alone, match
nothing; repeated rows are each returned; lines are ended by \\n; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.license_texts import DIGESTS, LICENSES

#: Most texts that a folder may hold: they become literals of the query.
MOST_TEXTS = 500
#: Regular expressions with their replacements, in the order in which they are applied. \1 is a group.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©(]*(?:copyright|©|\(c\)|all rights reserved)[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
BLANKS = r"\s*\n\s*"
SPELLINGS = (
    (r"licenc(e|es|ed|ing|or|ors|ee|ees)([ \n])", r"licens\1\2"),
    (r"([a-z]{2,})is(e|es|ed|ing|er|ers|ation|ations)([ \n])", r"\1iz\2\3"),
    (r"([a-z]{2,})our(s|ed|ing|able|ite|ites)?([ \n])", r"\1or\2\3"),
    (r"(cent|calib|fib|theat)re(s?)([ \n])", r"\1er\2\3"),
    (r"(acknowledg|judg)ement(s?)([ \n])", r"\1ment\2\3"),
    (r"non (commercial|infringement|exclusive)", r"non\1"),
    (r"sub licens", r"sublicens"),
    (r"copyright owner", r"copyright holder"),
)


def canonical(text: Column) -> Column:
    """Canonical lines, joined by \\n, without empty ones."""
    out = F.concat(F.lit("\n"), F.lower(F.coalesce(text, F.lit(""))), F.lit("\n"))
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, ""), PUNCTUATION, " "), BLANKS, "\n")
    for pattern, by in SPELLINGS:
        out = F.regexp_replace(out, pattern, by.replace("\\", "$"))
    return F.btrim(out, F.lit(" \n"))


def _digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text, "\n", " "), 256)


def read_texts(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Texts of licences, one a file below ``path``, by the file's name, for ``known``; more than MOST_TEXTS are an error."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("k"), "value").limit(MOST_TEXTS + 1).collect()
    if len(rows) > MOST_TEXTS:
        raise ValueError(f"at most {MOST_TEXTS} texts")
    return sorted((r.k.removesuffix(".txt"), r.value) for r in rows)


def catalogue(docs: DataFrame, known: Sequence[tuple[str, str]] = LICENSES, digests: Sequence[tuple[str, str]] = DIGESTS) -> DataFrame:
    """Distinct digests of the known texts, and those that are known as such; as many rows as were given, at most."""
    longer = F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(d).alias("digest")) for k, d in digests])
    rows = docs.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("t")) for k, t in known])))
    rows = rows.select("license_id", _digest(canonical(F.col("t"))).alias("digest"))
    if digests:
        rows = rows.union(docs.sparkSession.range(1).select(F.inline(longer)))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def whole_texts(docs: DataFrame, known: Sequence[tuple[str, str]] = LICENSES) -> DataFrame:
    """One row a document: doc_id and license_id of the whole text, or null. Nothing is shuffled."""
    digests = docs.select("doc_id", _digest(canonical(F.col("text"))).alias("digest"))
    return digests.join(F.broadcast(catalogue(docs, known)), "digest", "left").select("doc_id", "license_id")


def scan(docs: DataFrame, known: Sequence[tuple[str, str]] = LICENSES) -> DataFrame:
    """``whole_texts`` with the notices that lines of a document make: doc_id, license_id, notice_ids (sorted, joined by commas), n_notices."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), canonical(F.col("text")).alias("c"))
    unit = lambda whole, t: F.struct(F.lit(whole).alias("whole"), t.alias("t"))
    units = texts.select("doc_id", "h", F.explode(F.concat(F.array(unit(True, F.col("c"))), F.transform(F.split("c", "\n"), lambda x: unit(False, x)))).alias("u"))
    units = units.select("doc_id", "h", "u.whole", _digest(F.col("u.t")).alias("digest"))
    looked = units.join(F.broadcast(catalogue(docs, known)), "digest", "left")
    line = F.when(~F.col("whole"), F.col("license_id"))
    found = looked.groupBy("doc_id", "h").agg(
        F.min(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"),
        F.array_join(F.sort_array(F.collect_set(line)), ",").alias("notice_ids"),
        F.count(line).alias("n"),
        F.count(F.when(F.col("whole"), 1)).alias("rows"),
    )
    return found.select("doc_id", "license_id", "notice_ids", (F.col("n") / F.col("rows")).cast("long").alias("n_notices"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("r")).drop("r")
