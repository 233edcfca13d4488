"""Spelling variants by a symmetric-delete join.

Every word emits itself (place 0) and its single deletions with the places of their code points,
and what shares a key meets in one shuffle. Two deletions of a key at the same place are words that
differ in that one code point; a word's deletion that is another word lacks one code point of it.
So distance one is exact by key and place, no pair is met twice, and nothing further apart meets.
The members of a key are bounded by letters and places, and even those are not paired: each takes
the count and the two best of its place, and the word that the key itself is. Forms are aggregated
a word; roots follow forms by doubling, a written table a round, of which there are as many as the
logarithm of the longest chain, which is short as every step multiplies the count by RATIO.

Defined cases: null texts have no words; a null doc_id counts as the text ``null`` in the checksum;
rows that repeat count each; of near words with equal counts the smallest in code-point order is the
form; empty tables give empty results; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions.shared import written

#: Code points of words; others part them.
LETTERS = r"A-Za-zÀ-ÿ"
#: A run whose checksum this number divides loses a code point.
SLIP = 199
#: Words have so many code points and occurrences at least; a form is so many times as frequent as its word.
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5


def _without(word: Column, place: Column) -> Column:
    """``word`` without its code point at ``place`` (from 1)."""
    return F.concat(F.substring(word, F.lit(1), place - 1), F.substring(word, place + 1, F.length(word)))


def counted(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n): words of all texts, A-Z in lower case, with slips where the checksum of document and run says so."""
    text = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    runs = docs.select(own.alias("own"), F.explode(F.split(text, f"[^{LETTERS}]+")).alias("run")).where(F.length("run") >= min_length)
    h = F.crc32(F.concat_ws(":", "own", "run").cast("binary"))
    slipped = _without(F.col("run"), (F.pmod(h, F.length("run").cast("long")) + 1).cast("int"))
    words = runs.select(F.when(F.pmod(h, F.lit(slip)) == 0, slipped).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def near_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words`` (word, n) with n_near, the number of words at distance one, and form and form_n, the most frequent of them if it is ``ratio`` times as frequent."""
    place = F.sequence(F.lit(0), F.length("word"))
    emitted = words.select("word", "n", F.explode(place).alias("place")).withColumn("key", F.when(F.col("place") == 0, F.col("word")).otherwise(_without(F.col("word"), F.col("place"))))
    # equal code points in a row give one deletion, which is their first's
    first = (F.col("place") > 0) & (F.substring("word", F.col("place"), F.lit(1)) != F.when(F.col("place") > 1, F.substring("word", F.col("place") - 1, F.lit(1))).otherwise(F.lit("")))
    rank = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    emitted = emitted.select("*", first.alias("first"), rank.alias("rank"))
    key, same = Window.partitionBy("key"), Window.partitionBy("key", "place")
    ordered = same.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = emitted.select(
        "word", "n", "rank", "place", "first",
        F.max(F.when(F.col("place") == 0, F.col("rank"))).over(key).alias("itself"),
        F.count(F.when(F.col("first"), 1)).over(key).alias("longer"),
        F.min(F.when(F.col("first"), F.col("rank"))).over(key).alias("best_longer"),
        F.count(F.lit(1)).over(same).alias("replaced"),
        F.first("rank").over(ordered).alias("one"),
        F.nth_value("rank", 2).over(ordered).alias("two"),
    )
    shorter = F.col("first") & F.col("itself").isNotNull()
    whole = F.col("place") == 0
    found = met.select(
        "word", "n",
        F.when(whole, F.col("longer")).otherwise(F.col("replaced") - 1 + shorter.cast("long")).alias("c"),
        F.when(whole, F.col("best_longer")).otherwise(F.least(F.when(F.col("one") == F.col("rank"), F.col("two")).otherwise(F.col("one")), F.when(shorter, F.col("itself")))).alias("best"),
    )
    out = found.groupBy("word", "n").agg(F.sum("c").alias("n_near"), F.min("best").alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    return out.select("word", "n", "n_near", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` (a written table) with root: where following forms from a word ends, itself without a form."""
    ends = forms.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = ends.select(F.col("word").alias("at"), F.col("root").alias("further"))
        step = written(ends.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        ends = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return forms.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame) -> DataFrame:
    """One row a word of ``docs``: word, n, n_near, form, form_n, root."""
    words = written(counted(docs), "spelling-words")
    return with_roots(written(near_forms(words), "spelling-forms")).select("word", "form", "root", "n", "n_near", "form_n")
