"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet
and read again as the next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddgraph.llm import common, decontaminate, jaccard, langid, packing, repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_OLD: list[str] = []


def _staged(f: Stage) -> Stage:
    """Before a stage begins, the tables that earlier stages kept on the way are deleted: what those
    returned has been written by then."""

    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.delete(spark, _OLD)
        _OLD.clear()
        mark = common.mark()
        out = f(spark, docs, sf_dir)
        _OLD.extend(common.made_since(mark))
        return out

    return stage


@_staged
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go."""
    return langid.identified(docs, langid.fit(docs, ~common.held_out(F.col("doc_id"))))


@_staged
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with five-word shingles of similarity 0.8 or more, the one of the smallest id stays."""
    return jaccard.representatives(docs)


@_staged
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document of a smaller id holds are cut out."""
    return repeats.without_repeats(docs)


@_staged
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_staged
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their sequence and offset."""
    return packing.packed(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL cannot express the language model, BM25 search and the linear program; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
