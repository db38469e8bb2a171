"""A corpus pipeline of five stages; each takes the documents that the one before kept.

Toxicity drops what the chain calls toxic; exact dedup keeps one row of equal texts; MinHash keeps one document of each
component of near copies (five words, similarity 0.8); decontamination drops documents that overlap the benchmark; the
rest is encoded by BPE and decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import bpe, decontaminate, exact_dedup, minhash, toxicity
from netloom.llm.common import discard, stored
from netloom.llm.queries import WORD_BPE, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The chain learns from the labels of documents that are still there."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.where("not toxic").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near(docs, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(docs.select("doc_id", "text"), WORD_BPE, ("ids", "n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("BPE encoding and decoding", encode),
]

#: SQL can't train the classifier chain; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder, read again and deleted after the next stage."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{k}")
        discard(before)
    return docs
