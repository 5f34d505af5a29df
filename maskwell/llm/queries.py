"""The queries of this subpackage for __spark_entry__.py, one for each operator, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, langid, lm, near_dedup, pieces, pii, spotsigs, toxicity
from .common import fold, read_table
from .licenses import license_scan
from .token_files import token_files


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 7) == 2
    scored = lm.score(read_table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = fold("doc_id", 4) == 2
    return langid.identify(docs, langid.train(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), with_ids=False)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.to_json("spans").alias("spans"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held = fold("doc_id", 5) == 0
    scored = toxicity.score(docs, toxicity.train(docs, labels, ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spotsigs.fingerprints(read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join(F.col("signatures").cast("array<string>"), ",").alias("fingerprint"),
        F.array_join(F.col("edited_signatures").cast("array<string>"), ",").alias("edited_fingerprint"),
        spotsigs.likeness("signatures", "edited_signatures").alias("near_edited"),
        spotsigs.likeness("signatures", "next_signatures").alias("near_next"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in sorted(globals().items()) if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {}
