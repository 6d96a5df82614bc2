"""Distributed row numbering / running counts within a key.

``row_number() over (partition by key order by seq)`` puts a whole key into
one task.  Here the order column is cut into ``seq`` buckets: each (key,
bucket) slice is numbered locally, the per-bucket counts (and optional sums)
are prefix-summed over the small (key, bucket) table, and the offsets are
joined back.  No task ever holds more than one bucket of one key, however
large the key is.  Used by W-02 (batch ids), K-03 (cut to count) and A-22
(sticky persona status).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: Sequence[str], seq_col: str, bucket_width: int = 1 << 20,
           sums: dict[str, Column] | None = None, base: DataFrame | None = None) -> DataFrame:
    """Adds ``rank`` (1-based position within the key by ``seq_col``, ties not
    allowed) and, for each ``name -> expr`` in ``sums``, the running sum
    ``name`` up to and including the row.  ``base`` (the keys, ``rank`` and each
    ``name``) says what a key has before the first row; others start from 0."""
    keys = list(keys)
    sums = sums or {}
    b = df.withColumn("_bucket", F.floor(F.col(seq_col) / F.lit(bucket_width)).cast("bigint"))
    for name, expr in sums.items():
        b = b.withColumn(f"_v_{name}", expr)
    wl = Window.partitionBy(*keys, "_bucket").orderBy(seq_col).rowsBetween(Window.unboundedPreceding, 0)
    local = b.select("*", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(seq_col)).alias("_lr"),
                     *[F.sum(f"_v_{n}").over(wl).alias(f"_ls_{n}") for n in sums])
    tot = b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_bt"),
                                          *[F.sum(f"_v_{n}").alias(f"_bs_{n}") for n in sums])
    wb = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, "_bucket", F.coalesce(F.sum("_bt").over(wb), F.lit(0)).alias("_ot"),
                     *[F.coalesce(F.sum(f"_bs_{n}").over(wb), F.lit(0)).alias(f"_os_{n}") for n in sums])
    if base is not None:
        off = off.join(base.select(*keys, F.col("rank").alias("_br"), *[F.col(n).alias(f"_b_{n}") for n in sums]), keys, "left")
        off = off.select(*keys, "_bucket", (F.col("_ot") + F.coalesce("_br", F.lit(0))).alias("_ot"),
                         *[(F.col(f"_os_{n}") + F.coalesce(f"_b_{n}", F.lit(0))).alias(f"_os_{n}") for n in sums])
    j = local.join(off, [*keys, "_bucket"])
    out = j.withColumn("rank", (F.col("_lr") + F.col("_ot")).cast("bigint"))
    for n in sums:
        out = out.withColumn(n, F.col(f"_ls_{n}") + F.col(f"_os_{n}"))
    drop = ["_bucket", "_lr", "_ot"] + [c for n in sums for c in (f"_v_{n}", f"_ls_{n}", f"_os_{n}")]
    return out.drop(*drop)
