"""String column functions (S-*, P-22).  All are JVM-side expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip()/split() whitespace: Unicode White_Space plus the
# ASCII file/group/record/unit separators.
_WS = r"[\s\x1c-\x1f]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Python ``str.strip()`` (Spark ``trim`` removes spaces only)."""
    return F.regexp_replace(_c(x), rf"(?U)^{_WS}+|{_WS}+$", "")


def py_split_words(x) -> Column:
    """Python ``str.split()``: split on whitespace runs, no empty items."""
    stripped = py_strip(x)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, rf"(?U){_WS}+"))


def contains_any(x, needles: Iterable[str]) -> Column:
    """Substring test against a keyword list (not word matching, on purpose)."""
    needles = list(needles)
    if not needles:
        return F.lit(False)
    col = _c(x)
    out = None
    for n in needles:
        term = F.contains(col, F.lit(n))
        out = term if out is None else (out | term)
    return out


def count_occurrences(x, needle: str) -> Column:
    """Non-overlapping occurrences of ``needle`` (Python ``str.count``)."""
    col = _c(x)
    if not needle:
        return F.length(col) + 1
    return ((F.length(col) - F.length(F.replace(col, F.lit(needle), F.lit(""))))
            / F.lit(len(needle))).cast("bigint")


def prefix(x, n: int) -> Column:
    """``s[:n]`` (P-22); code points, like Python."""
    return F.substring(_c(x), 1, n)


def strip_fence(x) -> Column:
    """S-06: stripped reply; if it starts with a fence keep the part between the
    first two fences, drop a leading ``json``, strip again."""
    s = py_strip(x)
    inner = F.element_at(F.split(s, "```"), 2)
    inner = F.when(F.startswith(inner, F.lit("json")), F.substring(inner, 5, 1 << 30)).otherwise(inner)
    return py_strip(F.when(F.startswith(s, F.lit("```")), inner).otherwise(s))


def comma_list(x) -> Column:
    """S-14: ``"a, b,,c"`` -> ``["a","b","c"]``."""
    return F.filter(F.transform(F.split(_c(x), ","), lambda e: F.trim(e)), lambda e: e != "")


def sorted_tag_key(tags) -> Column:
    """S-15: tags sorted and joined by ``|``."""
    return F.array_join(F.array_sort(_c(tags)), "|")


def slug(x, n: int = 30) -> Column:
    """S-17: spaces -> ``_``, first n chars."""
    return F.substring(F.replace(_c(x), F.lit(" "), F.lit("_")), 1, n)


def unslug_lower(x) -> Column:
    """S-17: ``_`` -> space, lower case."""
    return F.lower(F.replace(_c(x), F.lit("_"), F.lit(" ")))


def nullif_empty(x) -> Column:
    """Python truthiness for strings: '' counts as missing."""
    col = _c(x)
    return F.when(col == "", F.lit(None)).otherwise(col)


def first_truthy(*cols) -> Column:
    """S-13: ``a or b or c`` over string columns."""
    return F.coalesce(*[nullif_empty(c) for c in cols])
