"""Grades, verdicts, priorities and time labels (P-12..P-15, S-18)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S
from .text import _c


def js_round_pct(rate) -> Column:
    """``Math.round((rate || 0) * 100)``: half-up on the double value."""
    r = F.coalesce(_c(rate), F.lit(0.0))
    return F.floor(r * 100 + F.lit(0.5)).cast("bigint")


def grade_letter(rate) -> Column:
    """P-13 letter from a pass rate in [0, 1]."""
    pct = js_round_pct(rate)
    out = F.lit(S.GRADE_FLOOR[0])
    for lo, letter, _ in reversed(S.GRADE_BANDS):
        out = F.when(pct >= lo, F.lit(letter)).otherwise(out)
    return out


def grade_label(rate) -> Column:
    pct = js_round_pct(rate)
    out = F.lit(S.GRADE_FLOOR[1])
    for lo, _, label in reversed(S.GRADE_BANDS):
        out = F.when(pct >= lo, F.lit(label)).otherwise(out)
    return out


def deploy_safe(rate, failures) -> Column:
    """P-14, report variant: raw ``pass_rate >= 0.8 and failures < 10``."""
    return (_c(rate) >= F.lit(S.DEPLOY_MIN_PASS_RATE)) & (_c(failures) < S.DEPLOY_MAX_FAILURES)


def deploy_safe_rounded(rate, failures) -> Column:
    """P-14, summary-text variant: rounded percent ``>= 80`` (differs on [0.795, 0.8))."""
    return (js_round_pct(rate) >= int(S.DEPLOY_MIN_PASS_RATE * 100)) & (_c(failures) < S.DEPLOY_MAX_FAILURES)


def deploy_verdict_text(safe: Column) -> Column:
    return F.when(safe, F.lit("SAFE TO DEPLOY")).otherwise(F.lit("FIX BEFORE DEPLOY"))


def default_priority(failure_type) -> Column:
    """P-12: failure type -> HIGH/MEDIUM/LOW, unknown -> MEDIUM."""
    m = F.create_map(*[F.lit(x) for kv in S.DEFAULT_FAILURE_PRIORITY.items() for x in kv])
    return F.coalesce(F.try_element_at(m, _c(failure_type)), F.lit("MEDIUM"))


def priority_rank(priority) -> Column:
    col = _c(priority)
    return F.when(col == "HIGH", 0).when(col == "MEDIUM", 1).when(col == "LOW", 2).otherwise(3)


def relative_time(ts, now) -> Column:
    """P-15: 'Just now' / 'Nm ago' / 'Nh ago' / 'Nd ago' / date, against a given now."""
    t = _c(ts)
    mins = F.floor((F.unix_micros(_c(now).cast("timestamp")) - F.unix_micros(t.cast("timestamp")))
                   / F.lit(60_000_000)).cast("bigint")
    hrs = F.floor(mins / 60).cast("bigint")
    days = F.floor(hrs / 24).cast("bigint")
    return (F.when(t.isNull(), F.lit("—"))
             .when(mins < 1, F.lit("Just now"))
             .when(mins < 60, F.concat(mins.cast("string"), F.lit("m ago")))
             .when(hrs < 24, F.concat(hrs.cast("string"), F.lit("h ago")))
             .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
             .otherwise(F.date_format(t, "yyyy-MM-dd")))
