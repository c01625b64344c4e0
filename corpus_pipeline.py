"""The corpus pipeline: from raw documents to token ids.

Each stage takes all documents its predecessor kept and returns those it keeps, with the columns of the documents table;
the last returns tokens.  `run` writes each stage's result as Parquet in the shared folder and rereads it, so a lost
executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postsift.llm import bpe, decontaminate, order_minhash, quality_rules, toxicity
from postsift.llm.common import table
from postsift.llm.queries import tokenizer
from postsift.session import Rounds


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled ones among the stage's own documents; those that score 0.5 or more go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base check, or whose posterior quality is under 0.5, go."""
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays."""
    return order_minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the bytes they decode to, and the ids."""
    path, pattern = tokenizer()
    return bpe.round_trip(docs, path, pattern, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic), ("quality rules", drop_low_quality), ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated), ("tokens", tokenize),
]

# A trained classifier, estimated accuracies, sketches and BPE are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rounds = table(spark, sf_dir, "documents"), Rounds(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = rounds.keep(stage(spark, docs, sf_dir), "documents")
    return STAGES[-1][1](spark, docs, sf_dir)
