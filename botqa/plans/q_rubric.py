"""Registered queries: rubrics, rubric roll-up, policy summary, rubric prompt (P-25..P-30, PR-02)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import rubric as RB
from ..sources import fixtures as FX
from .registry import register

_SYS_SQL = """
sys AS (
  SELECT company AS system, k, 'Company ' || CAST(k AS VARCHAR) AS company_name,
         CASE k % 3 WHEN 0 THEN 'CUSTOMER_SUPPORT' WHEN 1 THEN 'RAG' ELSE 'MULTI_AGENT' END AS system_type,
         k <> 6 AS has_config,
         CASE WHEN k % 2 = 0 THEN CAST(100 * (k + 1) AS DOUBLE) END AS refund_threshold,
         CAST(k * 5 AS DOUBLE) AS max_discount_percent,
         CASE WHEN k % 3 = 0 THEN ['lawyer', 'fraud'] ELSE [] END AS escalate_on_keywords,
         CASE WHEN k % 2 = 1 THEN ['refund', 'cancel'] ELSE [] END AS allowed_actions,
         CASE WHEN k > 3 THEN ['delete_account'] ELSE [] END AS prohibited_actions,
         CASE WHEN k % 3 = 1 THEN 30 END AS return_window_days,
         k = 2 AS hipaa_enabled, k % 2 = 0 AS gdpr_enabled, k <> 4 AS citation_required,
         CASE WHEN k % 2 = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS hallucination_tolerance,
         k >= 2 AS human_in_loop_required, CASE WHEN k % 2 = 0 THEN ['payment'] ELSE [] END AS human_in_loop_triggers,
         CASE WHEN k = 5 THEN ['shell'] ELSE [] END AS prohibited_tools,
         CASE WHEN k % 3 = 2 THEN CAST(2.5 AS DOUBLE) END AS max_cost_per_run,
         CASE WHEN k % 2 = 0 THEN 'decline' ELSE 'redirect' END AS out_of_scope_behavior,
         CASE WHEN k = 5 THEN 0 ELSE 20 END AS max_steps, k % 4 AS max_turns_before_escalate
  FROM (SELECT DISTINCT company, CAST(substr(company, 4) AS INT) AS k FROM runs) c)
"""


def _systems(t):
    return policies(FX.runs(t).select("company").distinct())


def policies(c, *keep):
    """Policy columns of the company of each row."""
    c = c.withColumn("k", F.substring("company", 4, 8).cast("int"))
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    empty = F.array().cast("array<string>")
    kk = F.col("k")
    return c.select(
        *keep, F.col("company").alias("system"), "k", F.concat(F.lit("Company "), kk.cast("string")).alias("company_name"),
        F.when(kk % 3 == 0, "CUSTOMER_SUPPORT").when(kk % 3 == 1, "RAG").otherwise("MULTI_AGENT").alias("system_type"),
        (kk != 6).alias("has_config"),
        F.when(kk % 2 == 0, (kk + 1) * 100.0).alias("refund_threshold"),
        (kk * 5.0).alias("max_discount_percent"),
        F.when(kk % 3 == 0, arr("lawyer", "fraud")).otherwise(empty).alias("escalate_on_keywords"),
        F.when(kk % 2 == 1, arr("refund", "cancel")).otherwise(empty).alias("allowed_actions"),
        F.when(kk > 3, arr("delete_account")).otherwise(empty).alias("prohibited_actions"),
        F.when(kk % 3 == 1, F.lit(30)).alias("return_window_days"),
        (kk == 2).alias("hipaa_enabled"), (kk % 2 == 0).alias("gdpr_enabled"), (kk != 4).alias("citation_required"),
        F.when(kk % 2 == 0, F.lit(0.0)).otherwise(F.lit(0.1)).alias("hallucination_tolerance"),
        (kk >= 2).alias("human_in_loop_required"),
        F.when(kk % 2 == 0, arr("payment")).otherwise(empty).alias("human_in_loop_triggers"),
        F.when(kk == 5, arr("shell")).otherwise(empty).alias("prohibited_tools"),
        F.when(kk % 3 == 2, F.lit(2.5)).alias("max_cost_per_run"),
        F.when(kk % 2 == 0, "decline").otherwise("redirect").alias("out_of_scope_behavior"),
        F.when(kk == 5, F.lit(0)).otherwise(F.lit(20)).alias("max_steps"),
        (kk % 4).alias("max_turns_before_escalate"))


def _worded_sql(template):
    """A wording with its policies as a SQL expression."""
    lists = ("escalate_on_keywords", "allowed_actions", "prohibited_actions", "human_in_loop_triggers", "prohibited_tools")
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join((f"array_to_string({p}, ', ')" if p in lists else f"CAST({p} AS VARCHAR)") if i % 2 else "'" + p.replace("'", "''") + "'"
                       for i, p in enumerate(parts))


def _criteria_sql():
    cond = {
        None: "TRUE", "has_config": "has_config",
        "refund_threshold": "has_config AND refund_threshold IS NOT NULL",
        "max_discount_percent": "has_config AND max_discount_percent > 0",
        "escalate_on_keywords": "has_config AND len(escalate_on_keywords) > 0",
        "allowed_actions": "has_config AND len(allowed_actions) > 0",
        "prohibited_actions": "has_config AND len(prohibited_actions) > 0",
        "return_window_days": "has_config AND COALESCE(return_window_days, 0) <> 0",
        "hipaa_enabled": "has_config AND hipaa_enabled", "gdpr_enabled": "has_config AND gdpr_enabled",
        "citation_required": "has_config AND citation_required",
        "zero_hallucination_tolerance": "has_config AND hallucination_tolerance = 0.0",
        "human_in_loop": "has_config AND human_in_loop_required AND len(human_in_loop_triggers) > 0",
        "prohibited_tools": "has_config AND len(prohibited_tools) > 0",
        "max_cost_per_run": "has_config AND max_cost_per_run IS NOT NULL",
        "max_steps": "has_config AND max_steps <> 0",
    }
    parts = []
    for st, rows in RB.CRITERIA.items():
        if st == "GENERIC":
            continue
        for i, (name, w, req, c) in enumerate(rows):
            told = ", ".join(f"{_worded_sql(x)} AS {c2}" for x, c2 in zip(
                RB.WORDING[st, name], ("description", "pass_condition", "fail_condition"), strict=True))
            parts.append(f"SELECT system, system_type, {i} AS ord, '{name}' AS name, {told}, CAST({w} AS DOUBLE) AS weight, "
                         f"{'TRUE' if req else 'FALSE'} AS required FROM sys WHERE system_type = '{st}' AND ({cond[c]})")
    return "crit AS (" + "\nUNION ALL\n".join(parts) + ")"


_CRIT_SQL = "WITH " + _SYS_SQL.strip() + ",\n" + _criteria_sql() + "\n"


@register("P25_P28_rubric_criteria", _CRIT_SQL
          + "SELECT system, system_type, ord, name, description, pass_condition, fail_condition, weight, required FROM crit")
def p25_p28_rubric(t):
    """P-25..P-28: rubric criteria per system with their wording, driven by its policies and routed by system type."""
    return RB.generate_rubric(_systems(t)).select("system", "system_type", F.col("ord").cast("int").alias("ord"), "name", "description",
                                                  "pass_condition", "fail_condition", "weight", "required")


@register("P29_rubric_rollup", _CRIT_SQL + """,
j AS (SELECT r.result_id, c.name, c.weight, c.required, (r.result_id + c.ord) % 5 <> 0 AS passed
      FROM results r JOIN crit c ON c.system = r.company)
SELECT result_id, COALESCE(bool_and(passed) FILTER (WHERE required), TRUE) AS passed,
       SUM(CASE WHEN passed THEN weight ELSE 0.0 END) / SUM(weight) AS weighted_score, COUNT(*) AS criteria
FROM j GROUP BY result_id
""")
def p29_rollup(t):
    """P-29: overall verdict from judged criteria — all required pass; weighted score."""
    res = policies(FX.results(t), "result_id")
    judged = F.transform(RB.criteria_array(), lambda c: c.withField("passed", (F.col("result_id") + c["ord"]) % 5 != 0))
    return res.select("result_id", judged.alias("judged")).select(
        "result_id", *[c.alias(n) for n, c in RB.rubric_rollup(F.col("judged")).items()])


@register("P30_policy_summary", "WITH " + _SYS_SQL.strip() + """
, l AS (SELECT system, list_filter([
    CASE WHEN refund_threshold IS NOT NULL THEN '- Refund threshold: escalate if above $' || CAST(refund_threshold AS VARCHAR) END,
    CASE WHEN len(escalate_on_keywords) > 0 THEN '- Always escalate if user mentions: ' || array_to_string(escalate_on_keywords, ', ') END,
    CASE WHEN max_turns_before_escalate <> 0 THEN '- Escalate after ' || CAST(max_turns_before_escalate AS VARCHAR) || ' failed turns' END,
    CASE WHEN hallucination_tolerance IS NOT NULL THEN '- Hallucination tolerance: ' || CAST(hallucination_tolerance AS VARCHAR) END,
    CASE WHEN len(allowed_actions) > 0 THEN '- Allowed actions: ' || array_to_string(allowed_actions, ', ') END,
    CASE WHEN len(prohibited_actions) > 0 THEN '- Prohibited actions: ' || array_to_string(prohibited_actions, ', ') END
  ], lambda x: x IS NOT NULL) AS lines FROM sys)
SELECT system, CASE WHEN len(lines) > 0 THEN array_to_string(lines, chr(10)) ELSE 'No specific policies defined.' END AS policy_summary FROM l
""")
def p30_policy_summary(t):
    """P-30: policy lines of the generator prompt per system."""
    return RB.policy_summary(_systems(t))


RUBRIC_SQL = _CRIT_SQL + """,
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY system ORDER BY ord) AS n FROM crit),
txt AS (SELECT system, string_agg('CRITERION ' || CAST(n AS VARCHAR) || ': ' || upper(name) || chr(10) || 'Description: ' || description || chr(10)
                                  || 'PASS if: ' || pass_condition || chr(10) || 'FAIL if: ' || fail_condition || chr(10) || 'Weight: '
                                  || CAST(weight AS VARCHAR) || ' | Required: ' || CASE WHEN required THEN 'True' ELSE 'False' END,
                                  chr(10) || chr(10) ORDER BY ord) AS criteria_text FROM rk GROUP BY system),
rub AS (SELECT s.system, 'You are evaluating an AI system response for ' || s.company_name || '.' || chr(10) || 'System type: ' || s.system_type
       || chr(10) || chr(10) || 'Evaluate the response against these criteria:' || chr(10) || chr(10) || t.criteria_text
       || chr(10) || chr(10) || 'For each criterion return:' || chr(10) || '- verdict: "pass" or "fail"' || chr(10)
       || '- reason: one sentence explaining why' || chr(10) || chr(10) || 'Then return an overall verdict:' || chr(10)
       || '- passed: true only if all REQUIRED criteria pass' || chr(10) || '- failure_type: the most serious failure type if failed'
       || chr(10) || '  (HALLUCINATION, POLICY_VIOLATION, INCOMPLETE,' || chr(10) || '   WRONG_ANSWER, CONTEXT_LOSS, ESCALATION_FAILURE)'
       || chr(10) || '- confidence: 0.0-1.0 how confident you are in this verdict' || chr(10) || chr(10)
       || 'Return as JSON only. No explanation. No markdown.' AS rubric
FROM sys s JOIN txt t ON t.system = s.system)
"""


@register("PR02_rubric_prompt", RUBRIC_SQL + "SELECT system, rubric AS prompt FROM rub")
def pr02_rubric_prompt(t):
    """PR-02: judge rubric prompt per system."""
    return RB.rubric_prompt(_systems(t))
