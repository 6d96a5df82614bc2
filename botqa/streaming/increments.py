"""Increments of a ``foreachBatch`` sink, merged level by level.

Batch n writes ``batch_id=<n>``.  Each time ``FAN`` folders of a level are full, the
sink merges them into one folder of the next: ``level=<l>/span=<i>`` holds the
batches from i * FAN^l on.  The spans of a level never overlap, so a folder and
what it was merged from are never read together, and after n batches a view reads
at most FAN - 1 folders of each of its log(n) levels.  A folder whose job did not
commit is passed over for the folders below it, so a lost merge loses and doubles
nothing; a repeated batch writes the same rows again and makes up for a lost merge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.folders import complete, numbers

FAN = 8

Merge = Callable[[DataFrame], DataFrame]


def _folder(out: str, level: int, span: int) -> str:
    return f"{out}/level={level}/span={span}" if level else f"{out}/batch_id={span}"


def _parts(spark: SparkSession, out: str, level: int, span: int, fan: int) -> list[str]:
    """The widest complete folders that hold the batches of a span."""
    if complete(spark, _folder(out, level, span)):
        return [_folder(out, level, span)]
    if not level:
        return []
    return [p for i in range(span * fan, (span + 1) * fan) for p in _parts(spark, out, level - 1, i, fan)]


def cover(spark: SparkSession, out: str, batches: int, fan: int = FAN) -> list[str]:
    """The folders that hold the first ``batches`` batches, each of them once."""
    found, at = [], 0
    while at < batches:
        level = 0
        while at % fan ** (level + 1) == 0 and at + fan ** (level + 1) <= batches:
            level += 1
        found += _parts(spark, out, level, at // fan ** level, fan)
        at += fan ** level
    return found


def compact(spark: SparkSession, out: str, schema, batch_id: int, merge: Merge, fan: int = FAN) -> None:
    """Write the folders whose last batch is ``batch_id``, from the lowest level up."""
    level = 1
    while (batch_id + 1) % fan ** level == 0:
        span = batch_id // fan ** level
        if not complete(spark, _folder(out, level, span)):
            held = spark.read.schema(schema).parquet(*_parts(spark, out, level, span, fan))
            merge(held).write.mode("overwrite").parquet(_folder(out, level, span))
        level += 1


def read_increments(spark: SparkSession, out: str, schema, merge: Merge, fan: int = FAN) -> DataFrame:
    """What all batches written so far come to."""
    paths = cover(spark, out, max(numbers(spark, out, "batch_id"), default=-1) + 1, fan)
    return merge(spark.read.schema(schema).parquet(*paths)) if paths else spark.createDataFrame([], schema)
