"""The operators applied to whole tables, with production parameters."""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.llm import sql
from verbena.llm.class_lm import lm_scores
from verbena.llm.decontamination import decontamination_report
from verbena.llm.embedding_dedup import embedding_groups
from verbena.llm.jaccard_join import jaccard_groups
from verbena.llm.repeats import repeat_report
from verbena.llm.secrets import secret_digest
from verbena.llm.sentencepiece import encode_digest, model_bytes
from verbena.llm.sharding import hilbert_shards
from verbena.llm.toxicity import toxicity_report
from verbena.llm.url_filter import EXAMPLE_ENTRIES, judge_captures

#: The model file that op4 and the pipeline use; a parameter of the operator.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


@functools.lru_cache(maxsize=1)
def piece_model() -> bytes:
    return model_bytes(PIECE_MODEL)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"), piece_model())


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the example list, as fetched on a day that its id gives."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("fetched_on", F.expr("date_add(date'2024-01-01', cast(pmod(page_id * 37, 366) as int))"))
    entries = spark.createDataFrame(EXAMPLE_ENTRIES, "key string, effective string, action string")
    return judge_captures(pages, entries).select("page_id", "host", "fetched_on", "verdict", "matched_key", "valid_from", "valid_to")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), size=3, percent=90)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_hilbert, op3_secrets, op4_sentencepiece, op5_jaccard_join, op6_url_filter, op7_toxicity, op8_class_lm, op9_repeats, op10_embeddings)
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": sql.DECONTAMINATION,
    "op5_jaccard_join": sql.JACCARD,
    "op6_url_filter": sql.URL_FILTER,
    "op9_repeats": sql.REPEATS,
    "op10_embeddings": sql.EMBEDDINGS,
}
