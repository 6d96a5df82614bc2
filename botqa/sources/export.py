"""Sinks: fine-tuning exports, reports and summaries (SRC-12..SRC-16, CSV).

Every writer is a distributed ``DataFrameWriter`` call (one file per task);
nothing is collected to the driver.  The *_lines functions return the text
column so the same rows can be inspected or compared before writing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finetune_jsonl_lines(pairs: DataFrame) -> DataFrame:
    """SRC-12: ``{"messages":[user, assistant], "metadata":{failure_type, difficulty}}`` per pair."""
    msg = F.array(
        F.struct(F.lit("user").alias("role"), F.col("input").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("correct_output").alias("content")))
    meta = F.struct("failure_type", "difficulty")
    return pairs.select("scenario_id", F.to_json(F.struct(msg.alias("messages"), meta.alias("metadata")))
                        .alias("value"))


def write_finetune_jsonl(pairs: DataFrame, path: str) -> None:
    finetune_jsonl_lines(pairs).select("value").write.mode("overwrite").text(path)


def write_finetune_json(pairs: DataFrame, path: str) -> None:
    """SRC-13: the full pairs as JSON records (one object per line, not one array:
    a single array would have to pass through one task)."""
    pairs.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export of any flat result table, quotes doubled as other readers expect."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_text(lines: DataFrame, path: str, col: str = "value") -> None:
    """SRC-15/SRC-16 text sinks."""
    lines.select(F.col(col).alias("value")).write.mode("overwrite").text(path)
