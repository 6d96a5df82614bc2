"""Numeric column functions.

``py_round`` reproduces Python's ``round(x, n)`` on doubles: the *exact*
binary value is rounded half-to-even.  Spark's ``round`` is half-up on the
shortest decimal string and ``bround`` is half-even on that string, so both
differ from Python on values such as 6.25 (tie, Python 6.2) or 0.15 (just
below the tie in binary, Python 0.1).

Method: Dekker's error-free product splits ``x * 10**n`` into ``p + e``
exactly (``p`` the double product, ``e`` its rounding error).  The fraction
``p - floor(p)`` is exact, so comparing it with 0.5 (and looking at the sign
of ``e`` only when it equals 0.5) decides the direction exactly.  Valid for
n <= 8 and |x| < 2**44; all pure column arithmetic (codegen, no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1


def py_round(x, n: int) -> Column:
    col = F.col(x) if isinstance(x, str) else x
    if not 0 <= n <= 8:
        raise ValueError("py_round supports 0..8 decimals")
    scale = float(10 ** n)
    a = F.abs(col)
    c = a * F.lit(_SPLIT)
    hi = c - (c - a)
    lo = a - hi
    p = a * F.lit(scale)
    e = (hi * F.lit(scale) - p) + lo * F.lit(scale)
    k = F.floor(p).cast("double")
    q = p - k
    up = (q > 0.5) | ((q == 0.5) & (e > 0)) | ((q == 0.5) & (e == 0) & (F.pmod(k, F.lit(2.0)) == 1.0))
    mag = F.when(up, k + 1.0).otherwise(k) / F.lit(scale)
    return F.when(col.isNull(), F.lit(None).cast("double")).when(
        F.isnan(col), col).otherwise(F.when(col < 0, -mag).otherwise(mag))


def py_round_sql(expr: str, n: int) -> str:
    """The same computation as DuckDB SQL text (for the oracle statements)."""
    scale = f"CAST({10 ** n} AS DOUBLE)"
    a = f"ABS(CAST({expr} AS DOUBLE))"
    c = f"({a} * CAST(134217729 AS DOUBLE))"
    hi = f"({c} - ({c} - {a}))"
    lo = f"({a} - {hi})"
    p = f"({a} * {scale})"
    e = f"(({hi} * {scale} - {p}) + {lo} * {scale})"
    k = f"FLOOR({p})"
    q = f"({p} - {k})"
    up = f"({q} > 0.5 OR ({q} = 0.5 AND {e} > 0) OR ({q} = 0.5 AND {e} = 0 AND CAST({k} AS BIGINT) % 2 = 1))"
    mag = f"((CASE WHEN {up} THEN {k} + 1 ELSE {k} END) / {scale})"
    return f"(CASE WHEN ({expr}) < 0 THEN -{mag} ELSE {mag} END)"
