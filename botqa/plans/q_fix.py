"""Registered queries: fix recommendations (J-12, K-02, L-04, A-27, A-28, J-02)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import py_round_sql
from ..operators import analyze as AN
from ..operators import fix as FXO
from ..sources import fixtures as FX
from .registry import register


def _patterns(t, res=None):
    res = (FX.results(t) if res is None else res).withColumn("seq", F.col("result_id"))
    pats = AN.patterns_by_type(res.where(~F.col("passed")), carry=["company"])
    k = F.substring("company", 4, 8).cast("int") % 3
    st = F.when(k == 0, "CUSTOMER_SUPPORT").when(k == 1, "RAG").otherwise("MULTI_AGENT")
    return pats.select("run_id", "pattern_rank", "failure_type", "priority",
                       F.col("scenario_count").alias("affected_scenarios"),
                       F.lower("type_key").alias("cluster_label"), F.lit("").alias("root_cause"),
                       st.alias("system_type"))


def _fixes(t, res=None):
    res = FX.results(t) if res is None else res
    plan = FXO.apply_fix_replies(FXO.fix_plan(_patterns(t, res)))
    stats = AN.run_statistics(res)
    pairs = (res.where(~F.col("passed") & F.col("failure_type").isNotNull())
                .groupBy("run_id").agg(F.count(F.lit(1)).alias("pairs")))
    ft = FXO.fine_tuning_fix(pairs, stats)
    cols = ["run_id", "failure_type", "affected_scenarios", "fix_type", "priority", "title", "problem",
            "suggested_fix", "implementation_steps", "verification_scenarios", "estimated_impact", "disclaimer"]
    fixes = plan.select(*cols, "pattern_rank").unionByName(
        ft.select(*cols, F.lit(None).cast("int").alias("pattern_rank")))
    return FXO.order_fixes(fixes), stats


_PAT = """
WITH f AS (SELECT * FROM results WHERE NOT passed),
g AS (SELECT run_id, company, COALESCE(failure_type, 'UNKNOWN') AS type_key, COUNT(*) AS n, MIN(result_id) AS first
      FROM f GROUP BY ALL),
pat AS (
  SELECT run_id, type_key,
         CASE WHEN type_key IN ('HALLUCINATION','POLICY_VIOLATION','INCOMPLETE','WRONG_ANSWER','CONTEXT_LOSS','ESCALATION_FAILURE') THEN type_key ELSE 'WRONG_ANSWER' END AS failure_type,
         n AS affected_scenarios,
         ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY n DESC, first) AS pattern_rank,
         CASE CAST(substr(company, 4) AS INT) % 3 WHEN 0 THEN 'CUSTOMER_SUPPORT' WHEN 1 THEN 'RAG' ELSE 'MULTI_AGENT' END AS system_type
  FROM g),
pp AS (SELECT *, CASE WHEN failure_type IN ('POLICY_VIOLATION','ESCALATION_FAILURE','HALLUCINATION') THEN 'HIGH'
                      WHEN failure_type = 'CONTEXT_LOSS' THEN 'LOW' ELSE 'MEDIUM' END AS prio FROM pat),
plan AS (
  SELECT run_id, pattern_rank, failure_type, affected_scenarios, 'PROMPT_ADDITION' AS fix_type, prio AS priority, 0 AS fo FROM pp
  UNION ALL SELECT run_id, pattern_rank, failure_type, affected_scenarios, 'GUARDRAIL_RULE', prio, 1 FROM pp
  UNION ALL SELECT run_id, pattern_rank, failure_type, affected_scenarios, 'ARCHITECTURE_CHANGE', 'MEDIUM', 2 FROM pp WHERE system_type = 'RAG'
  UNION ALL SELECT run_id, pattern_rank, failure_type, affected_scenarios, 'POLICY_CLARIFICATION', 'HIGH', 3 FROM pp WHERE failure_type = 'POLICY_VIOLATION'),
st AS (SELECT run_id, COUNT(*) AS total, CAST(SUM(CASE WHEN passed THEN 0 ELSE 1 END) AS BIGINT) AS failed_count,
              """ + py_round_sql("SUM(CASE WHEN passed THEN 1 ELSE 0 END) / CAST(COUNT(*) AS DOUBLE)", 4) + """ AS pr,
              SUM(CASE WHEN NOT passed AND failure_type IS NOT NULL THEN 1 ELSE 0 END) AS pairs
       FROM results GROUP BY run_id),
allfix AS (
  SELECT run_id, pattern_rank, failure_type, affected_scenarios, fix_type, priority, fo FROM plan
  UNION ALL SELECT run_id, NULL, 'WRONG_ANSWER', failed_count, 'FINE_TUNING_DATA', 'MEDIUM', 4 FROM st WHERE pairs > 0),
ordered AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END,
                                                          affected_scenarios DESC, COALESCE(pattern_rank, 1073741824), fo) AS fix_rank
  FROM allfix)
"""


@register("J12_fix_plan", _PAT + """
SELECT run_id, CAST(pattern_rank AS INT) AS pattern_rank, failure_type, fix_type, priority FROM plan
""")
def j12_fix_plan(t):
    """J-12: applicable fix types per failure pattern."""
    return FXO.fix_plan(_patterns(t)).select("run_id", F.col("pattern_rank").cast("int").alias("pattern_rank"),
                                            "failure_type", "fix_type", "priority")


@register("K02_fix_order", _PAT + """
SELECT run_id, CAST(fix_rank AS INT) AS fix_rank, fix_type, CAST(pattern_rank AS INT) AS pattern_rank, priority, affected_scenarios
FROM ordered
""")
def k02_fix_order(t):
    """K-02/L-04: all fixes of a run (incl. the fine-tuning fix) in priority order."""
    fixes, _ = _fixes(t)
    return fixes.select("run_id", F.col("fix_rank").cast("int").alias("fix_rank"), "fix_type",
                        F.col("pattern_rank").cast("int").alias("pattern_rank"), "priority",
                        F.col("affected_scenarios").cast("bigint").alias("affected_scenarios"))


@register("L04_fine_tuning_fix", _PAT + """
SELECT run_id, failed_count AS affected_scenarios, CAST(pairs AS VARCHAR) || ' Training Pairs Available' AS title,
       'Download the JSONL training data from Quality Monitor|Review pairs to confirm correct outputs are appropriate|Fine-tune your model using standard SFT training|Re-run Quality Monitor to verify improvement|Repeat until pass rate reaches target' AS implementation_steps,
       'Run Quality Monitor again after fine-tuning|Check if previously failing scenarios now pass' AS verification_scenarios
FROM st WHERE pairs > 0
""")
def l04_fine_tuning_fix(t):
    """L-04: fine-tuning fix per run with training pairs."""
    fixes, _ = _fixes(t)
    return fixes.where(F.col("fix_type") == "FINE_TUNING_DATA").select(
        "run_id", F.col("affected_scenarios").cast("bigint").alias("affected_scenarios"), "title",
        F.array_join("implementation_steps", "|").alias("implementation_steps"),
        F.array_join("verification_scenarios", "|").alias("verification_scenarios"))


_REPORT = """
, agg AS (SELECT run_id, COUNT(*) AS total_fixes,
               SUM(CASE WHEN priority = 'HIGH' THEN 1 ELSE 0 END) AS h,
               SUM(CASE WHEN priority = 'MEDIUM' THEN 1 ELSE 0 END) AS m,
               SUM(CASE WHEN priority = 'LOW' THEN 1 ELSE 0 END) AS l,
               SUM(CASE WHEN priority = 'HIGH' THEN affected_scenarios ELSE 0 END) AS hs
        FROM allfix GROUP BY run_id),
x AS (SELECT st.*, COALESCE(total_fixes, 0) AS total_fixes, COALESCE(h, 0) AS h, COALESCE(m, 0) AS m,
             COALESCE(l, 0) AS l, COALESCE(hs, 0) AS hs FROM st LEFT JOIN agg USING (run_id)),
y AS (SELECT *, GREATEST(0, failed_count - LEAST(hs, failed_count)) AS nf FROM x),
told AS (
  SELECT o.run_id, o.fix_rank, o.fix_type, o.priority,
         CASE o.fix_type WHEN 'PROMPT_ADDITION' THEN 'Prompt improvement suggestion' WHEN 'GUARDRAIL_RULE' THEN 'Guardrail rule suggestion'
              WHEN 'ARCHITECTURE_CHANGE' THEN 'Architecture improvement' WHEN 'POLICY_CLARIFICATION' THEN 'Policy clarification needed'
              ELSE CAST(st.pairs AS VARCHAR) || ' Training Pairs Available' END AS title,
         CASE WHEN o.fix_type = 'FINE_TUNING_DATA' THEN 'Your AI system made specific mistakes that can be corrected through targeted fine-tuning.' ELSE '' END AS problem,
         CASE WHEN o.fix_type = 'FINE_TUNING_DATA' THEN 'Download ' || CAST(st.pairs AS VARCHAR) || ' training pairs generated from your actual failures. Each pair contains the problematic input and the correct expected output. Fine-tune your open-source model on these pairs to correct the specific failure patterns found.' ELSE '' END AS suggested_fix,
         CASE WHEN o.fix_type = 'FINE_TUNING_DATA' THEN 'On-policy learning from ' || CAST(st.pairs AS VARCHAR) || ' real failure cases may significantly improve pass rate for open-source models' ELSE '' END AS impact
  FROM ordered o JOIN st ON st.run_id = o.run_id)
"""

ESTIMATE_SQL = f"""CASE WHEN total_fixes = 0 THEN 'No failures detected — system performing well'
            ELSE 'Implementing ' || CAST(h AS VARCHAR) || ' high priority fixes may improve pass rate from '
                 || CAST({py_round_sql("pr * 100", 1)} AS VARCHAR) || '% to an estimated '
                 || CAST({py_round_sql("(total - nf) / CAST(total AS DOUBLE) * 100", 1)} AS VARCHAR)
                 || '%. Results depend on implementation quality.' END"""


def report_sql(body: str) -> str:
    """``body`` after the CTEs of a run's fixes: y (report numbers by run), told (fixes with their texts)."""
    return _PAT + _REPORT + body


@register("A27_fix_report", report_sql(f"""
SELECT run_id, CAST(total_fixes AS BIGINT) AS total_fixes, CAST(h AS BIGINT) AS high_priority_count,
       CAST(m AS BIGINT) AS medium_priority_count, CAST(l AS BIGINT) AS low_priority_count,
       CAST(hs AS BIGINT) AS high_priority_scenarios,
       {py_round_sql("(total - nf) / CAST(total AS DOUBLE) * 100", 1)} AS estimated_new_pass_pct,
       {ESTIMATE_SQL} AS estimated_improvement
FROM y
"""))
def a27_fix_report(t):
    """A-27/A-28: fix counts by priority and the improvement estimate per run."""
    fixes, stats = _fixes(t)
    return FXO.fix_report(fixes, stats)


@register("J02_issues", """
WITH f AS (SELECT * FROM results WHERE NOT passed),
g AS (SELECT run_id, COALESCE(failure_type, 'UNKNOWN') AS type_key, COUNT(*) AS n, MIN(result_id) AS first FROM f GROUP BY ALL),
pat AS (SELECT run_id, type_key,
               CASE WHEN type_key IN ('HALLUCINATION','POLICY_VIOLATION','INCOMPLETE','WRONG_ANSWER','CONTEXT_LOSS','ESCALATION_FAILURE') THEN type_key ELSE 'WRONG_ANSWER' END AS failure_type,
               ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY n DESC, first) AS rk FROM g),
lastp AS (SELECT run_id, failure_type, arg_max(type_key, rk) AS label,
                 arg_max(CASE WHEN failure_type IN ('POLICY_VIOLATION','ESCALATION_FAILURE','HALLUCINATION') THEN 'HIGH'
                              WHEN failure_type = 'CONTEXT_LOSS' THEN 'LOW' ELSE 'MEDIUM' END, rk) AS prio
          FROM pat GROUP BY run_id, failure_type)
SELECT f.result_id, f.run_id, f.failure_type, COALESCE(lastp.prio, 'MEDIUM') AS issue_priority, lower(lastp.label) AS pattern_label
FROM f LEFT JOIN lastp ON lastp.run_id = f.run_id AND lastp.failure_type = f.failure_type
""")
def j02_issues(t):
    """J-02: failed results with the (last) pattern of their type and its priority."""
    pats = _patterns(t).select("run_id", "failure_type", "pattern_rank", "cluster_label", "root_cause", "priority")
    res = FX.results(t)
    return FXO.issues(res, pats).select("result_id", "run_id", "failure_type", "issue_priority", "pattern_label")
