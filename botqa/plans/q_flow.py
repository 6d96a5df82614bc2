"""Registered query: one run from the bot's replies to the fix report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grades as G
from ..operators import analyze as AN
from ..operators import fix as FXO
from ..session import cut_lineage
from . import q_fix as QF
from . import q_prompt as QP
from .registry import register

_HEAD = f"""
WITH res AS (
{QP.QUERIES_P04}
),
judged AS (SELECT scenario_id AS result_id, company AS run_id, company, passed, failure_type FROM res),
"""
_BODY = f"""
, bd AS (SELECT run_id, string_agg(failure_type || ':' || CAST(n AS VARCHAR), ',' ORDER BY failure_type) AS failure_breakdown
         FROM (SELECT run_id, failure_type, COUNT(*) AS n FROM judged WHERE NOT passed AND failure_type IS NOT NULL GROUP BY ALL) b GROUP BY run_id),
np AS (SELECT run_id, COUNT(*) AS patterns FROM pat GROUP BY run_id),
ff AS (SELECT run_id, fix_type AS first_fix, title AS first_fix_title FROM told WHERE fix_rank = 1)
SELECT run_id, total, total - failed_count AS passed_count, failed_count, pr AS pass_rate,
       CASE WHEN FLOOR(pr * 100 + 0.5) >= 90 THEN 'A' WHEN FLOOR(pr * 100 + 0.5) >= 80 THEN 'B' WHEN FLOOR(pr * 100 + 0.5) >= 70 THEN 'C'
            WHEN FLOOR(pr * 100 + 0.5) >= 60 THEN 'D' ELSE 'F' END AS grade,
       COALESCE(failure_breakdown, '') AS failure_breakdown, COALESCE(patterns, 0) AS patterns,
       CAST(total_fixes AS BIGINT) AS total_fixes, CAST(h AS BIGINT) AS high_priority_count,
       first_fix, first_fix_title, {QF.ESTIMATE_SQL} AS estimated_improvement
FROM y LEFT JOIN bd USING (run_id) LEFT JOIN np USING (run_id) LEFT JOIN ff USING (run_id)
"""


@register("RUN_replies_to_report", _HEAD + QF.report_sql(_BODY).replace("FROM results", "FROM judged").replace("WITH ", "", 1))
def replies_to_report(t):
    """Replies -> rules and panel -> results -> statistics, patterns -> fixes in order -> report, one run per company
    (P-04, A-01, A-02, A-05, J-12, L-04, K-02, A-27, A-28 on each other's output)."""
    judged = cut_lineage(QP._judged(t).select(
        F.col("scenario_id").alias("result_id"), F.col("company").alias("run_id"), "company", "passed", "failure_type",
        "confidence_score", "latency_ms"), "judged")
    fixes, stats = QF._fixes(t, judged)
    patterns = QF._patterns(t, judged).groupBy("run_id").agg(F.count(F.lit(1)).alias("patterns"))
    breakdown = AN.breakdown_text(AN.failure_breakdown(judged)).drop("breakdown_map")
    first = fixes.where("fix_rank = 1").select("run_id", F.col("fix_type").alias("first_fix"), F.col("title").alias("first_fix_title"))
    out = stats
    for part in (FXO.fix_report(fixes, stats), breakdown, patterns, first):
        out = out.join(part, "run_id", "left")
    return out.select("run_id", "total", "passed_count", "failed_count", "pass_rate", G.grade_letter("pass_rate").alias("grade"),
                      F.coalesce("failure_breakdown", F.lit("")).alias("failure_breakdown"),
                      F.coalesce("patterns", F.lit(0)).alias("patterns"), "total_fixes", "high_priority_count",
                      "first_fix", "first_fix_title", "estimated_improvement")
