"""Numbered folders ``<key>=<n>`` that Spark jobs write one after another.

A folder counts once its job has committed (``_SUCCESS``); what a lost job left
behind is overwritten by the next attempt and read by nobody.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, in whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether the job that writes ``path`` has committed."""
    return exists(spark, f"{path}/_SUCCESS")


def numbers(spark: SparkSession, path: str, key: str) -> list[int]:
    """Ascending numbers of the folders ``<key>=<n>`` in ``path``, complete or not."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{key}="))
