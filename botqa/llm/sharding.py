"""Sharding by a Feistel permutation with cycle walking.

Rows get global numbers 0 to N-1 in the order of given columns; a keyed Feistel
network permutes the numbers, so a row's shard and slot can be computed from its
number alone, without a table, and again from shard and slot back to the number.
The network works on pairs (left, right) of a x b >= N values with a and b near
the root of N: fewer than a numbers lie beyond N, and a row that lands there is
sent through again (cycle walking).  Position p goes to shard p mod ``shards``,
slot p div ``shards``: shard sizes differ by one at most and slots have no gaps.

Edges: rows that tie in the order are interchangeable and get numbers of their
own; nulls come first; an empty table gives an empty result; other columns of the
input pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged, with_row_numbers

ROUNDS = 6


def _halves(n: int) -> tuple[int, int]:
    """Sizes of the two halves: a * b >= n, a the larger."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def permute(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """Replace the numbers in ``column`` by their image under one pass of the
    network (a permutation of 0 .. a*b-1)."""
    a, b = _halves(n)
    left, right = fresh(df, "left"), fresh(df, "right")
    df = df.withColumns({left: F.floor(F.col(column) / F.lit(b)) if n < 1 << 50 else F.expr(f"{column} div {b}"),
                         right: F.col(column) % F.lit(b)})
    for i in range(ROUNDS):
        to, of, size = (left, right, a) if i % 2 == 0 else (right, left, b)
        df = df.withColumn(to, (F.col(to) + F.pmod(F.xxhash64(of, F.lit(seed * ROUNDS + i)), F.lit(size))) % F.lit(size))
    return df.withColumn(column, F.col(left) * F.lit(b) + F.col(right)).drop(left, right)


def longest_walk(spark, n: int, seed: int) -> int:
    """Passes that bring every number below n back below n.  Follows the numbers
    beyond n (fewer than the root of n, on Spark) until only closed cycles, which
    no row enters, are left."""
    a, b = _halves(n)
    beyond, passes = spark.range(n, a * b), 1
    before = a * b - n
    while before:
        # written before the filter, which else is pushed through the rounds and doubles in each
        beyond = staged(permute(beyond, "id", n, seed), "beyond").where(F.col("id") >= n)
        now = beyond.count()
        if now == before:
            break
        before, passes = now, passes + 1
    return passes


def assign_shards(df: DataFrame, order: list[Column], shards: int, seed: int = 11) -> DataFrame:
    """``df`` with ``row_number``, ``position``, ``shard`` (int) and ``slot``.

    Columns of these names in ``df`` may be ordered by, and give way.
    """
    ranked = with_row_numbers(df, order, "row_number")
    n = ranked.count()
    out = ranked.withColumn("position", F.col("row_number"))
    for i in range(longest_walk(df.sparkSession, n, seed)):
        if i:  # only rows beyond n walk on
            again = fresh(out, "again")
            out = permute(out.withColumn(again, F.col("position")), again, n, seed)
            out = out.withColumn("position", F.when(F.col("position") >= n, F.col(again)).otherwise(F.col("position"))).drop(again)
        else:
            out = permute(out, "position", n, seed)
    return out.withColumns({"shard": (F.col("position") % shards).cast("int"),
                            "slot": F.floor((F.col("position") - F.col("position") % shards) / shards)})
