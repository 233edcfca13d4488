"""Quality rules by weak supervision.

Every rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation
over the counts of vote patterns (at most 3**len(RULES) of them, whatever the input) estimates
how often each rule is right on good and on bad documents, and the posterior probability of
"good" decides, instead of a demand that all rules pass.

Defined cases: null text counts as no words (base rules fail it); empty tables give empty
results; repeated rows are judged one by one and alike; columns besides doc_id and text pass
through untouched whatever their names, unless they begin with ``__q_``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions.shared import written
from peakloom.llm.words import SPACE_CHARS, SPACES, count_chars, let, words

SYMBOLS, MARKS, TERMINALS, CAPITALS = "#*$%&|<>", "#*$%&|<>!", ".!?", r"\p{Lu}"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_terminals", "n_upper")

#: (rule, numerator, denominator, good within [low, high], bad outside [low, high]).
RULES = (
    ("length", "n_words", None, (100.0, math.inf), (50.0, math.inf)),
    ("word_length", "word_chars", "n_words", (3.5, 7.0), (2.5, 10.0)),
    ("symbols", "n_symbols", "n_words", (0.0, 0.02), (0.0, 0.1)),
    ("marks", "n_marks", "n_words", (0.0, 0.05), (0.0, 0.3)),
    ("duplicate_lines", "n_dup_lines", "n_lines", (0.0, 0.1), (0.0, 0.5)),
    ("repeated_words", "n_repeat_words", "n_words", (0.0, 0.1), (0.0, 0.4)),
    ("sentences", "n_terminals", "n_words", (0.03, 0.25), (0.01, 0.6)),
    ("upper_case", "n_upper", "word_chars", (0.0, 0.08), (0.0, 0.3)),
)
#: Where expectation-maximisation starts, and the weight of that start in pseudo-documents.
START_PRIOR, START_GOOD, START_BAD, PSEUDO = 0.9, 0.95, 0.5, 10.0
ITERATIONS = 10
MAX_REPEAT_PERCENT, MIN_WORDS = 50, 50


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are compared by 64-bit hash."""
    grams = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.filter(F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"])), lambda p: p.isNotNull()))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda p: F.array(p, p + 1, p + 2)))))

    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct ``__q`` of FEATURES (all long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    by_words = let(words(text), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    worded = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    by_lines = let(worded, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    wide = docs.withColumns({"__q_w": by_words, "__q_l": by_lines})
    values = {
        "n_words": F.col("__q_w.n"),
        "word_chars": F.length(F.regexp_replace(text, SPACES, "")),
        "n_symbols": count_chars(text, SYMBOLS),
        "n_dup_lines": F.col("__q_l.d"),
        "n_repeat_words": F.col("__q_w.r"),
        "n_lines": F.col("__q_l.n"),
        "n_marks": count_chars(text, MARKS),
        "n_terminals": count_chars(text, TERMINALS),
        "n_upper": count_chars(text, CAPITALS),
    }
    return wide.withColumn("__q", F.struct(*[values[k].cast("long").alias(k) for k in FEATURES])).drop("__q_w", "__q_l")


def votes() -> list[Column]:
    """One column of 1, 0 or -1 a rule, out of the struct ``__q``. Rules abstain on documents without words."""
    out = []
    for _, top, bottom, (good_low, good_high), (bad_low, bad_high) in RULES:
        x = F.col(f"__q.{top}").cast("double")
        if bottom:
            x = x / F.col(f"__q.{bottom}")
        inside = lambda x, low, high: (x >= low) & (x <= high) if high < math.inf else x >= low
        out.append(F.when(F.col("__q.n_words") == 0, 0).when(inside(x, good_low, good_high), 1).when(~inside(x, bad_low, bad_high), -1).otherwise(0))
    return out


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents; for each rule the chance of a right vote, given that it votes, on good and on bad ones."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def probability(self, votes: tuple[int, ...]) -> float:
        """Chance that a document with these votes is good."""
        z = math.log(self.prior / (1 - self.prior))
        for v, g, b in zip(votes, self.good, self.bad, strict=True):
            z += math.log(g / (1 - b)) if v == 1 else math.log((1 - g) / b) if v == -1 else 0.0
        return _sigmoid(z)

    def posterior(self, votes: list[Column]) -> Column:
        z = F.lit(math.log(self.prior / (1 - self.prior)))
        for v, g, b in zip(votes, self.good, self.bad, strict=True):
            z = z + F.when(v == 1, math.log(g / (1 - b))).when(v == -1, math.log((1 - g) / b)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else 1 - 1 / (1 + math.exp(z))


def fit(featured: DataFrame, iterations: int = ITERATIONS) -> VoteModel:
    """Expectation-maximisation over all documents that pass the base rules: one aggregate to the counts of their vote patterns, which are 3**len(RULES) rows at most whatever the input."""
    names = [f"v{i}" for i in range(len(RULES))]
    rows = featured.where(~base_failed()).select(*[v.alias(n) for v, n in zip(votes(), names, strict=True)]).groupBy(*names).agg(F.count(F.lit(1)).alias("c")).collect()
    patterns = sorted((tuple(r[n] for n in names), r["c"]) for r in rows)
    model = VoteModel(START_PRIOR, (START_GOOD,) * len(RULES), (START_BAD,) * len(RULES))
    for _ in range(iterations):
        good = [(v, c * p, c * (1 - p)) for v, c in patterns for p in (model.probability(v),)]
        right = lambda i, vote, k: sum(row[k] for row in good if row[0][i] == vote)
        voted = lambda i, k: sum(row[k] for row in good if row[0][i])
        model = VoteModel(
            (sum(row[1] for row in good) + PSEUDO * START_PRIOR) / (sum(c for _, c in patterns) + PSEUDO),
            tuple((right(i, 1, 1) + PSEUDO * START_GOOD) / (voted(i, 1) + PSEUDO) for i in range(len(RULES))),
            tuple((right(i, -1, 2) + PSEUDO * START_BAD) / (voted(i, 2) + PSEUDO) for i in range(len(RULES))),
        )
    return model


def base_failed() -> Column:
    return (F.col("__q.n_words") < MIN_WORDS) | (100 * F.col("__q.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__q.n_words"))


def judge(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, FEATURES, base_failed, posterior, kept."""
    featured = written(features(docs.select("doc_id", "text")).select("doc_id", "__q"), "quality-features")
    model = fit(featured)
    return featured.select("doc_id", "__q.*", base_failed().alias("base_failed"), model.posterior(votes()).alias("posterior")).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the base rules and the vote model keep, with their own columns. Texts are not shuffled; they are written once with their features."""
    featured = written(features(docs), "featured-texts")
    model = fit(featured)
    return featured.where(~base_failed() & (model.posterior(votes()) >= 0.5)).select(*[F.col(f"`{c}`") for c in docs.columns])
