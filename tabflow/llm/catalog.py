"""Queries of this subpackage: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm import decontaminate, gru_lm, hard_negatives, jaccard, langid, pieces, secrets, sharding, superkmers
from tabflow.llm import oracles, syncmers, token_counts, toxicity, variants
from tabflow.llm.common import crc_mod, table
from tabflow.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def vocabulary_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "pos", "nth", F.length("found").alias("length"),
                        F.sha2("found", 256).alias("found_sha256"), "score", "is_secret")


@query("op2_lm_score")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gru_lm.score_table(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) != 0)
    return out.select("doc_id", (crc_mod("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known",
                      "train_tokens", "base_score", "score")


@query("op3_substring_dedup", oracles.SUBSTRING_DEDUP)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


@query("op4_jaccard_join", oracles.JACCARD_JOIN)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op5_sentencepiece")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_documents(docs, vocabulary_file(), out=("digests",)).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op6_decontaminate", oracles.DECONTAMINATE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query("op7_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, crc_mod("doc_id", 3) != 1)
    return toxicity.score_documents(docs, model).select(
        "doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, crc_mod("doc_id", 4) != 2)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred",
                        F.col("lang_score").alias("score"))


@query("op10_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_documents(table(spark, sf_dir, "documents"))


@query("op11_hard_negatives", oracles.HARD_NEGATIVES)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    label = F.when(v % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), v % 100 == 0, label)


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_forms(variants.vocabulary(table(spark, sf_dir, "documents")))


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache starts empty: nothing that another call has counted is used."""
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"),
                                       scratch_path(spark, "token-counts"), keep=["doc_id"])
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
