"""A corpus pipeline of five stages; each works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.llm._common import materialise
from verbena.llm.decontamination import without_contaminated
from verbena.llm.jaccard_join import first_of_groups
from verbena.llm.queries import piece_model, table
from verbena.llm.secrets import redact_secrets
from verbena.llm.sentencepiece import encode
from verbena.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word n-grams, similarity 0.8."""
    return first_of_groups(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: doc_id, ids, n_tokens, parity."""
    return encode(docs, piece_model())


STAGES = [("toxicity", toxicity), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("secrets", secrets), ("sentencepiece", sentencepiece)]

#: A trained model, graph components and a tokenizer are beyond SQL; tests hold the rows
#: against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet and read again.

    Null and empty texts pass every stage and have no tokens; rows without doc_id are never copies;
    of equal rows that share a doc_id all stay or all go; extra columns go with their rows until
    the last stage; empty tables give no rows, and without labels or items nothing is dropped.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
