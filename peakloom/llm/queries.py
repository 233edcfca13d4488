"""One query for each operator of this subpackage, over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm import chat_format, filter_audit, license_scan, line_dedup, mixing, mpeg_audio, native_sql, near_dedup, ngram_lm, packing, quality_rules, spelling, warc_bundles, word_bpe


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.clean_lines(_table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_probe(_table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.format_conversations(rows))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(_table(spark, sf_dir, "documents"))


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.with_features(mpeg_audio.with_media(_table(spark, sf_dir, "documents")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).select("doc_id", *quality_rules.FEATURES[:5], "base_failed", "kept")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.round_trip(_table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = word_bpe.encode(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    both = word_bpe.decode(encoded)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failing = filter_audit.failures(_table(spark, sf_dir, "documents"))
    return filter_audit.audit(filter_audit.cells(failing, _table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_chat_formatting, op3_lm_scoring, op4_mpeg_audio, op5_mixing, op6_best_fit_packing, op7_quality_rules, op8_near_dedup, op9_warc, op10_license_scan, op11_word_bpe, op12_spelling_variants, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": native_sql.line_dedup_sql(),
        "op5_mixing": native_sql.mixing_sql(),
        "op7_quality_rules": native_sql.quality_sql(),
        "op8_near_dedup": native_sql.near_dedup_sql(),
        "op10_license_scan": native_sql.license_sql(),
        "op12_spelling_variants": native_sql.spelling_sql(),
        "op13_filter_audit": native_sql.audit_sql(),
    }
