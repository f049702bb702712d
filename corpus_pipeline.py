"""The corpus pipeline: documents to shuffled shards, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again
as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.decontaminate import decontaminated
from textloom.llm.mixing import mixed_documents
from textloom.llm.near_dup import deduplicated
from textloom.llm.quality import fit
from textloom.llm.shared import shared_dir
from textloom.llm.sharding import sharded


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on docs itself, does not reject; null and empty texts are judged like all others."""
    return fit(docs).score(docs).where("keep").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, similarity 0.8.

    Rows without an id or without words stay; rows that share an id are judged each by its own text.
    """
    return deduplicated(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text; null texts hold none and stay, null ids and repeated rows are rows like all others."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources along its curriculum: a row for each time that a document is begun, range-sorted by its training position.

    The position is the row's place in the table; its value is no column of documents.  A null source is a source of its own.
    """
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeats too, in a random order over 16 shards: shard, slot (with underscores where documents has such columns)."""
    return sharded(docs, shards=16)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing), ("sharding", sharding)]

#: Training a scorer and MinHash have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
