"""A training corpus from `documents`: five stages, each over all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.base import durable_dir, remove, table
from strandline.llm.mixing import mixed_documents
from strandline.llm.neardup_text import drop_near_duplicates
from strandline.llm.pieces import sample_segmentations
from strandline.llm.quality import keep_good, train_quality_model
from strandline.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null, empty and blank texts score alike and share their fate, as equal
    texts do. Without labels all documents score alike. Empty table: empty.
    """
    return keep_good(docs, train_quality_model(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id.

    Documents without words stay, and so do rows without an id; of rows that
    repeat an id one stays. Empty table: empty.
    """
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars follows; every document stays.

    Null and empty texts stay as they are. Empty table: empty.
    """
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' targets reads them.

    Texts without words are never read. A null source is a source. Empty
    table: empty.
    """
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every text.

    A null or empty text has one, without pieces; rows that repeat an id and a
    text have equal ones. Empty table: empty.
    """
    return sample_segmentations(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("encode", encode)]

#: The classifier and the sampling cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Each stage is written to the shared folder, and what it read from there is deleted; the last input stays, as the result is read from it."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{durable_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
