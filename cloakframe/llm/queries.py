"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_tree import digest
from .common import table
from .decontam import contamination
from .hnsw import nearest
from .langid import identify
from .pii import find_pii
from .secret_ledger import find_in_generations
from .sentencepiece_nbest import encode_texts
from .simhash import simhash_components
from .suffix_dedup import remove_repeats
from .toxicity import score_toxicity


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op3_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digest(rows.unionByName(extra))


def op4_toxicity_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_hnsw_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_in_generations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_language_mixture": op2_language_mixture,
    "op3_chat_prefix_tree": op3_chat_prefix_tree,
    "op4_toxicity_nearest": op4_toxicity_nearest,
    "op5_hnsw_shards": op5_hnsw_shards,
    "op6_simhash_golay": op6_simhash_golay,
    "op7_sentencepiece_nbest": op7_sentencepiece_nbest,
    "op8_spaced_seed_decontamination": op8_spaced_seed_decontamination,
    "op9_pii_weak_supervision": op9_pii_weak_supervision,
    "op10_secret_ledger": op10_secret_ledger,
}
ORACLE_SQL: dict[str, str] = {}
