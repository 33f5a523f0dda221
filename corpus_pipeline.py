"""A training corpus from raw documents: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from procatlas.llm import bpe, decontaminate, pii, similarity, toxicity
from procatlas.llm.queries import toxicity_model
from procatlas.llm.shared import ship, table
from procatlas.session import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of operator 7 rejects go."""
    ship(spark)
    return toxicity.drop_toxic(docs, toxicity_model(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of operator 3 stays, the one with the smallest doc_id."""
    ship(spark)
    return similarity.keep_one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which operator 4 finds a benchmark item go."""
    ship(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The spans of operator 1 are replaced by their kinds."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of operator 5."""
    ship(spark)
    return bpe.encode_documents(docs, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("decontamination", drop_benchmark),
          ("pii", redact_personal_data), ("byte_bpe", encode)]
#: Training, components and BPE are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
