"""The thin ``opN_<name>`` queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm.common import table
from loamwork.llm.decontaminate import contained_items
from loamwork.llm.exact_dedup import exact_dedup
from loamwork.llm.gated_lm import lm_scores
from loamwork.llm.hard_negatives import mine_hard_negatives
from loamwork.llm.line_dedup import line_dedup
from loamwork.llm.main_text import extract_main_text
from loamwork.llm.pii import KINDS, detect_pii
from loamwork.llm.merkle import manifest
from loamwork.llm.piece_bpe import piece_round_trip
from loamwork.llm.shard import shard_documents
from loamwork.llm.simhash import simhash_dedup
from loamwork.llm.token_counts import token_counts
from loamwork.llm.word_crf import fit_and_identify

PIECE_MODEL, BYTE_MODEL = "piece_bpe_32k.model", "byte_bpe_50k.json"


def piece_model() -> str:
    """Path of the public piece vocabulary, which is installed on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(PIECE_MODEL))


def byte_model() -> str:
    """Path of the public byte-level vocabulary, likewise."""
    import public_tokenizers

    return str(public_tokenizers.path(BYTE_MODEL))


def op1_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op4_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_round_trip(docs, piece_model()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op6_word_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return fit_and_identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return detect_pii(docs).select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return manifest(docs, found={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(moved, F.col("id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, byte_model(), limit=512).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_gated_lm, op2_exact_dedup, op3_simhash_dedup, op4_piece_round_trip, op5_jump_shards, op6_word_language, op7_line_dedup, op8_benchmark_leaks, op9_main_text, op10_pii, op11_merkle_manifest, op12_hard_negatives, op13_token_counts]
    return {f.__name__: f for f in every}
