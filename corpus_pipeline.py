"""A corpus pipeline of five operators: quality, near-duplicates, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its
result is written as Parquet and reread as the next stage's docs.

Nulls and rows, in every stage: a null text counts as empty (without features, of fingerprint zero, holding no item
and no personal data, packed as its end id) and stays null where texts are returned; a row with a null id is
judged by its own text like any other; repeated rows are each judged, and stage 2 leaves one of equal texts; a score
that equals the threshold keeps its document, of a near-duplicate class the smallest id stays and then the earliest row;
texts of any length are taken whole, in blocks; an empty table gives an empty table of the same columns; further
columns, whatever their names, go along unchanged up to the last stage, which returns its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import decontaminate, packing, pii, quality, simhash_dedup
from framewright.llm.common import free_name, shared_dir, table
from framewright.llm.registry import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality 1."""
    weights = quality.train(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    score = free_name(docs, "_score")
    got = quality.scored(docs, weights, out=score)
    return got.where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id."""
    return simhash_dedup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it replaced; n_chars follows the text."""
    got = pii.sanitised(docs)
    return got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else got


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their sequences and places."""
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]
#: A learnt classifier, fingerprints and tokenizers are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/framewright-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
