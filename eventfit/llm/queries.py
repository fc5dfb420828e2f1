"""Queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import (byte_bpe, filter_audit, near_embeddings, nbest, packing, quality_model, quality_rules, secret_scan, sharding, superminhash, token_alignment,
               token_count, toxicity)

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rate_documents(_docs(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(_docs(spark, sf_dir))


def packed(docs: DataFrame) -> DataFrame:
    """The places of all pieces, with the crc32 of their ids."""
    return packing.pack_documents(docs, public_tokenizers.path(BYTE_MODEL), public_tokenizers.PATTERN)[1]


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_docs(spark, sf_dir))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_docs(spark, sf_dir)).select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the scores of its best segmentations, a digest of the best, and whether it decodes to the text."""
    best = nbest.segment_documents(_docs(spark, sf_dir), public_tokenizers.path(PIECE_MODEL), decoded=True)
    return best.withColumn("best", F.element_at("segmentations", 1)).select(
        "doc_id", (F.length("best") / 4).cast("long").alias("n_pieces"), F.element_at("scores", 1).alias("best_score"),
        F.size("scores").alias("n_best"), F.array_join(F.transform("scores", lambda s: s.cast("string")), ",").alias("scores"),
        F.crc32("best").alias("ids_crc32"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan.scan_documents(_docs(spark, sf_dir))
    counts = [F.expr(f"size(filter(spans, s -> s.kind = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(secret_scan.KINDS[:3])]
    return scanned.select("doc_id", *counts, F.sha2(secret_scan.spans_text(F.col("spans"), base_only=True).cast("binary"), 256).alias("base_sha256"),
                          secret_scan.spans_text(F.col("spans")).alias("spans"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_docs(spark, sf_dir), public_tokenizers.path(PIECE_MODEL))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(_docs(spark, sf_dir), public_tokenizers.path(BYTE_MODEL), public_tokenizers.path(PIECE_MODEL))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document digests of its ids and of the text that they decode to."""
    file = public_tokenizers.path(BYTE_MODEL)
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(_docs(spark, sf_dir), file), file)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1,
    "op2_quality_rules": op2,
    "op3_toxicity": op3,
    "op4_minhash_near_dedup": op4,
    "op5_best_fit_packing": op5,
    "op6_sharding": op6,
    "op7_nbest_segmentation": op7,
    "op8_secret_scan": op8,
    "op9_token_counts": op9,
    "op10_quality_classifier": op10,
    "op11_token_alignment": op11,
    "op12_filter_audit": op12,
    "op13_byte_bpe": op13,
}
