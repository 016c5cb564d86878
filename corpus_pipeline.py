"""The corpus pipeline: language ID, near-duplicates, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import langid, mixing, near_dedup, spm_sampling
from shelfmark.llm.common import ensure_checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or with none in a script of any learned language, go; mixed languages stay."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the least doc_id; repeated rows and rows without doc_id are grouped too."""
    return near_dedup.drop_near_duplicates(docs, words=5)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for."""
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, with their inclusion scores."""
    return spm_sampling.encode(docs, "doc_id", ["doc_id", "lang", "source"])


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("encoding", encoding),
]

#: No stage but the third could be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
