"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the total size over its own size. Each
document draws its count from the Poisson distribution of that mean, by inverting it at a
uniform number that is hashed from a seed and the document's id; then it is exploded by its
count and all copies are dealt out by a hash and sorted by another within partitions, which is
one global shuffle.

Without explicit weights, shares follow size ** alpha. Sources absent from explicit weights get
rate 0. Sizes are code points of text, at least 1 a document.

Defined cases: null text has size 1; a null source is the source ''; a null doc_id draws as the
id 'null'; repeated rows of a document draw the same count, each; an empty table gives an empty
result; other columns pass through, those named like a result (whatever the case) with
underscores appended, unless their names begin with ``__m_``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions.shared import written
from peakloom.llm.columns import column, own_columns

ALPHA, SEED = 0.5, 20_240_501


def _source() -> Column:
    return F.coalesce(F.col("source"), F.lit(""))


def _hashed(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, epochs: float = 1.0) -> DataFrame:
    """__m_source, __m_size, __m_rate of every source; written once, so that its size is known to later joins."""
    size = F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long")
    sizes = written(docs.groupBy(_source().alias("__m_source")).agg(F.sum(size).alias("__m_size")), "source-sizes")
    if weights is None:
        weighed = sizes.withColumn("__m_weight", F.pow(F.col("__m_size").cast("double"), F.lit(alpha)))
    else:
        given = docs.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("__m_source"), F.lit(float(v)).alias("__m_weight")) for k, v in weights.items()])))
        weighed = sizes.join(given, "__m_source", "left").withColumn("__m_weight", F.coalesce("__m_weight", F.lit(0.0)))
    total = weighed.agg(F.sum("__m_size").alias("n"), F.sum("__m_weight").alias("w")).first()
    if not total["w"]:
        return weighed.select("__m_source", "__m_size", F.lit(0.0).alias("__m_rate"))
    return weighed.select("__m_source", "__m_size", (F.col("__m_weight") / total["w"] * total["n"] * epochs / F.col("__m_size")).alias("__m_rate"))


def poisson_count(rate: Column, u: Column) -> Column:
    """The least k whose cumulative probability reaches ``u``; terms are added far beyond what doubles can tell from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    state = lambda lp, cum, n: F.struct(lp.alias("lp"), cum.alias("cum"), n.alias("n"))

    def step(a: Column, k: Column) -> Column:
        cum = a["cum"] + F.exp(a["lp"])
        return state(a["lp"] + F.log(rate) - F.log(k + F.lit(1.0)), cum, a["n"] + F.when(cum < u, 1).otherwise(0))

    found = F.aggregate(F.sequence(F.lit(0), last), state(-rate, F.lit(0.0), F.lit(0)), step, lambda a: a["n"])
    return F.when(rate > 0, found).otherwise(F.lit(0))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = ALPHA, epochs: float = 1.0, seed: int = SEED, report: bool = True) -> DataFrame:
    """Copies of ``docs`` in random order, plus (if ``report``) copy (int, from 1) and shuffle_key."""
    by_source = written(rates(docs, weights, alpha, epochs), "source-rates")
    u = (F.conv(F.substring(_hashed(str(seed), F.col("doc_id")), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    drawn = docs.withColumn("__m_s", _source()).join(by_source, F.col("__m_s") == F.col("__m_source")).withColumn("__m_n", poisson_count(F.col("__m_rate"), u))
    copies = drawn.where("__m_n > 0").select(*[column(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__m_n"))).alias("__m_copy"))
    keyed = copies.withColumn("__m_key", _hashed(str(seed + 1), F.col("doc_id"), F.col("__m_copy")))
    dealt = keyed.repartition(F.col("__m_key")).sortWithinPartitions("__m_key")
    added = {"copy": "__m_copy", "shuffle_key": "__m_key"} if report else {}
    return dealt.select(*[column(c).alias(n) for c, n in own_columns(docs, added).items()], *[F.col(c).alias(n) for n, c in added.items()])
