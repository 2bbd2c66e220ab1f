"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, hard_negatives, langid, licences, packing, pii, quality, rules, sharding, simhash_dedup, simple8b, warc
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality.train(docs, labels.where(~quality.held_out()))
    got = quality.scored(docs.select("doc_id", "text"), weights)
    return got.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~quality.held_out())
    got = rules.judged(table(spark, sf_dir, "documents"), labels)
    return got.select("doc_id", *rules.COUNTS[:5], "base_failed", "kept", "rule")


def op7_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_simple8b_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


#: Shards of the query's cluster, which the grown one has one more than.
SHARDS = 24


def op12_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(table(spark, sf_dir, "documents"), sharding.topology(SHARDS), sharding.topology(SHARDS + 1))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_pii_sanitisation": op7_pii_sanitisation,
    "op8_licence_scan": op8_licence_scan,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_simple8b_token_ids": op10_simple8b_token_ids,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_hash_tree_shards": op12_hash_tree_shards,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op4_warc_revisits": warc.ORACLE,
    "op11_phrase_collocations": collocations.ORACLE,
    "op12_hash_tree_shards": sharding.oracle(sharding.topology(SHARDS), sharding.topology(SHARDS + 1)),
    "op13_hard_negatives": hard_negatives.ORACLE,
}
