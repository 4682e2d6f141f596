"""The training-data pipeline over ``documents``: stages and their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellmosaic.llm import decontaminate, jaccard_join, mixing, queries, range_coder, toxicity
from cellmosaic.llm.common import read_table, work_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    return jaccard_join.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without enough text of the benchmark to count as contaminated."""
    return decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token-id files of the mix; per document its place in them."""
    return range_coder.tokenize(docs, queries.token_vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("drop_toxic", drop_toxic),
    ("near_duplicates", near_duplicates),
    ("drop_contaminated", drop_contaminated),
    ("mix_sources", mix_sources),
    ("encode_ids", encode_ids),
]

# toxicity, components and encoded ids are beyond SQL; tests compare stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written as Parquet and read again by the next one."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
