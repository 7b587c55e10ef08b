"""From raw documents to packed sequences: each stage reads what the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinstats.llm.common import shared_dir, table
from kinstats.llm.debruijn import without_repeats
from kinstats.llm.lsa import matches
from kinstats.llm.packing import best_fit
from kinstats.llm.quality import keep_good
from kinstats.llm.similar import one_of_each
from kinstats.storage import scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts are rejected for their few words, repeated rows are judged alike."""
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays, in as many rows as have it."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that occur earlier go; the documents stay, with what is left of their text, which may be nothing."""
    return without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, or a paraphrase of one, go; null texts, and all documents where there are no passages, stay."""
    found = matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a null or empty text is its end token alone."""
    import public_tokenizers

    return best_fit(docs, public_tokenizers.path("word_bpe_49k.json"), known=100_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; each result is written to the shared folder and read again, and the tables
    that a stage saved on its way are deleted.

    Other columns pass through to the last stage; texts of any length are taken whole; without documents no stage has rows.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


#: Retrieval and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
