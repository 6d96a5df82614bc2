"""Streaming sources: the input tables read as file streams.

Each table is a Parquet dataset in ``sf_dir``; the stream picks its files
with ``pathGlobFilter`` and an explicit schema (no inference on a stream).
``maxFilesPerTrigger`` bounds a micro-batch, which bounds what any one key
can bring into a stateful step per trigger.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir
from ..sources.folders import complete, numbers


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    return (spark.readStream.schema(schema)
            .option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", max_files)
            .parquet(sf_dir))


class StreamTables:
    """Like :class:`botqa.sources.tables.Tables`, but every table is a stream."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return stream_table(self.spark, self.sf_dir, name)


def written_batches(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the batches whose folder ``batch_id=<n>`` under ``out`` is complete."""
    return [n for n in numbers(spark, out, "batch_id") if complete(spark, f"{out}/batch_id={n}")]


def stream_workdir(spark: SparkSession, job: str, folder: str | None = None) -> str:
    """The folder of a job's checkpoint and output.  A caller that names
    ``folder`` gets the same one at each launch, so a stopped job goes on where it
    was; without a name each launch is a job of its own, inside the shared folder
    that the cluster names in ``spark.checkpoint.dir``."""
    if folder:
        return f"{folder.rstrip('/')}/{job}"
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/streams/{job}-{uuid.uuid4().hex[:12]}"
