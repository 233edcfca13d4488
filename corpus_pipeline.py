"""Corpus pipeline: documents to packed training sequences.

Each stage takes the rows that its predecessor kept, written as Parquet and read again, and
returns the columns of documents; the last returns pieces with their places in sequences. Copies
that mixing makes are rows of their own, with the same doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions.shared import written
from peakloom.llm import line_dedup, mixing, near_dedup, packing, quality_rules

#: Near duplicates share this of their five-word shingles; op8's own threshold is higher.
NEAR_PERCENT = 80
#: A copy of another site's text that would lose more than this share of its characters is left to near-dedup.
COPY_SHARE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the vote model reject go."""
    return quality_rules.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, but for those that make up most of a text that other sites have too; all documents stay, with n_chars of the text that is left."""
    return line_dedup.clean_lines(docs, max_share=COPY_SHARE, copies_only=True, report=False).withColumn("n_chars", F.length("text").cast("long"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity NEAR_PERCENT or more) stays."""
    return near_dedup.keep_one_of_each(docs, percent=NEAR_PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, to the target weights of their sources."""
    return mixing.mix(docs, report=False)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]
#: Tokenizing and the genetic algorithm are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
