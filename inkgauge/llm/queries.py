"""The thirteen operators' queries, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, filter_audit, hard_negatives, licenses, line_dedup, near_dup, packing, quality, secrets, substring_dedup, toxicity, url_reputation
from .common import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner: the document's source; repository: the document."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents")).drop("p_good")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and the benchmark items they hold."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizer())


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_extra(spark, table(spark, sf_dir, "conversations"))
    return chat_format.digests(chat_format.format_chats(rows))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    every, n = hard_negatives.SHIFT_EVERY, hard_negatives.N_LABELS
    label = F.when(F.pmod(F.col("vec_id"), F.lit(every)) == 0, (F.col("label") + 1) % n).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_secrets, op3_near_dup, op4_url_reputation, op5_line_dedup, op6_quality, op7_decontamination, op8_packing,
                                  op9_licenses, op10_toxicity, op11_chat_format, op12_hard_negatives, op13_filter_audit)}


def _wrap(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries() -> dict:
    return {name: _wrap(fn) for name, fn in QUERIES.items()}
