"""The corpus pipeline: quality rules, line dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents. Further columns, whatever their names, pass through these; an empty table gives
an empty one. Results for nulls, empty and long texts, ties and repeated rows are said at each stage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import line_dedup, minhash, packing, quality, substring_dedup
from keystrata.llm._spark import shared_folder
from keystrata.llm.queries import END_ID

#: SQL can't express tokenisation and packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go; null and empty texts have no words and go, repeated rows are judged alike."""
    return quality.keep(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go. Null texts and null ids stay as they are; rows of one id, repeated ones too,
    lose only what smaller ids have."""
    return _measured(line_dedup.dedup_lines(docs)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the least id; of rows with one id the least text (null first). Null ids stay, and
    null and empty texts are in no group."""
    return minhash.drop_near_duplicates(docs).select(docs.columns)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that start in an earlier document go. Null and shorter texts and null ids stay
    as they are; rows of one id lose only what smaller ids have."""
    return _measured(substring_dedup.dedup_substrings(docs, min_words=50)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces with their places. Null text is the end token alone; each row, repeated or without an id, is packed."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, 1024)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("substring_dedup", dedup_substrings),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    folder = os.path.join(shared_folder(spark), f"pipeline_{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
