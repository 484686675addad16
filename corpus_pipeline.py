"""The corpus pipeline: each stage applies one training-data operator to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontam, mixing, neardup, quality, queries, sharding
from spanloom.llm.common import fresh, staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.score_quality(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of the n-gram Jaccard join."""
    return neardup.drop_duplicates(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents with a window similar to a benchmark item."""
    (found,) = fresh(docs, "matches")
    return decontam.with_matches(docs, table(spark, sf_dir, "benchmark"), column=found).where(F.size(found) == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; those that it does not take go."""
    (nth,) = fresh(docs, "nth")
    mixed = mixing.mix_sources(docs)
    return mixed.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias(nth)).drop(nth)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Names each row's shard."""
    return sharding.extendible_shards(docs, queries.SHARD_BYTES)


STAGES = [("quality", keep_quality), ("near_copies", keep_one_of_near_copies), ("decontamination", drop_benchmark_passages), ("mix", mix), ("shards", shard)]

#: No SQL says which rules a fit gives or which documents a seeded mix takes; tests compare what each stage keeps with a plain computation or with the operator's own tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)  # read again more than once by the next stage
    return STAGES[-1][1](spark, docs, sf_dir)
