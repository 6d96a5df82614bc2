"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botqa.llm.common import staged
from botqa.llm.decontaminate import without_leaks
from botqa.llm.mixing import mixed_documents
from botqa.llm.quality import Resampler
from botqa.llm.sharding import assign_shards
from botqa.llm.simhash import first_of_each

SHARDS = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling draws (operator 9)."""
    return Resampler(docs, _table(spark, sf_dir, "labels")).keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (operator 7)."""
    return first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item (operator 6)."""
    return without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents to meet the sources' targets, in training order (operator 10)."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the rows out to shards and slots (operator 5): doc_id, source,
    text_sha256, row_number, shard, slot.  ``row_number`` is the row's position
    in training: ``docs`` is a table that was written in that order, a range of
    it to each part file."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    rows = docs.select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), part.alias("part"),
                       F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    return (assign_shards(rows, [F.col("part"), F.col("file"), F.col("at")], SHARDS)
            .select("doc_id", "source", "text_sha256", "row_number", "shard", "slot"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: The classifier and the SimHash links have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a written table."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
