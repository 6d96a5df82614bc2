"""Registered queries: judging chain and run statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grades as G
from ..operators import analyze as AN
from ..operators import judge as J
from ..sources import fixtures as FX
from . import params as PP
from ..functions.numeric import py_round_sql
from .registry import register


def run_report(t):
    """Flagship: pass rate, grade, failure breakdown and deployment verdict per run
    (A-01 + A-02 + P-13 + P-14)."""
    res = FX.results(t)
    stats = AN.run_statistics(res)
    bd = AN.breakdown_text(AN.failure_breakdown(res)).drop("breakdown_map")
    r = stats.join(bd, "run_id", "left")
    return r.select(
        "run_id", "total", "passed_count", "failed_count", "pass_rate",
        G.js_round_pct("pass_rate").alias("pass_pct"),
        G.grade_letter("pass_rate").alias("grade"),
        G.grade_label("pass_rate").alias("grade_label"),
        G.deploy_verdict_text(G.deploy_safe("pass_rate", "failed_count")).alias("deployment_verdict"),
        G.deploy_verdict_text(G.deploy_safe_rounded("pass_rate", "failed_count")).alias("summary_verdict"),
        F.coalesce("failure_breakdown", F.lit("")).alias("failure_breakdown"))


_RUN_REPORT_SQL = """
WITH st AS (
  SELECT run_id, COUNT(*) AS total,
         CAST(SUM(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS passed_count
  FROM results GROUP BY run_id),
bd AS (
  SELECT run_id, string_agg(item, ',' ORDER BY item) AS failure_breakdown FROM (
    SELECT run_id, failure_type || ':' || CAST(COUNT(*) AS VARCHAR) AS item
    FROM results WHERE NOT passed AND failure_type IS NOT NULL GROUP BY run_id, failure_type) x
  GROUP BY run_id),
s AS (
  SELECT st.run_id, total, passed_count, total - passed_count AS failed_count,
         {pr} AS pass_rate, bd.failure_breakdown
  FROM st LEFT JOIN bd ON st.run_id = bd.run_id),
g AS (SELECT *, CAST(FLOOR(pass_rate * 100 + 0.5) AS BIGINT) AS pass_pct FROM s)
SELECT run_id, total, passed_count, failed_count, pass_rate, pass_pct,
       CASE WHEN pass_pct >= 90 THEN 'A' WHEN pass_pct >= 80 THEN 'B' WHEN pass_pct >= 70 THEN 'C'
            WHEN pass_pct >= 60 THEN 'D' ELSE 'F' END AS grade,
       CASE WHEN pass_pct >= 90 THEN 'Production Ready' WHEN pass_pct >= 80 THEN 'Good'
            WHEN pass_pct >= 70 THEN 'Needs Attention' WHEN pass_pct >= 60 THEN 'At Risk'
            ELSE 'Critical' END AS grade_label,
       CASE WHEN pass_rate >= 0.8 AND failed_count < 10 THEN 'SAFE TO DEPLOY' ELSE 'FIX BEFORE DEPLOY' END AS deployment_verdict,
       CASE WHEN pass_pct >= 80 AND failed_count < 10 THEN 'SAFE TO DEPLOY' ELSE 'FIX BEFORE DEPLOY' END AS summary_verdict,
       COALESCE(failure_breakdown, '') AS failure_breakdown
FROM g
""".replace("{pr}", py_round_sql("passed_count / CAST(total AS DOUBLE)", 4))
register("run_report", _RUN_REPORT_SQL)(run_report)


@register("A01_run_statistics", f"""
SELECT run_id, COUNT(*) AS total,
       CAST(SUM(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS passed_count,
       CAST(SUM(CASE WHEN passed THEN 0 ELSE 1 END) AS BIGINT) AS failed_count,
       {py_round_sql("SUM(CASE WHEN passed THEN 1 ELSE 0 END) / CAST(COUNT(*) AS DOUBLE)", 4)} AS pass_rate,
       {py_round_sql("SUM(latency_ms) / CAST(COUNT(*) AS DOUBLE)", 2)} AS avg_latency_ms,
       {py_round_sql("SUM(confidence_score) / CAST(COUNT(*) AS DOUBLE)", 4)} AS avg_confidence
FROM results GROUP BY run_id
""")
def a01_run_statistics(t):
    """A-01 run statistics per run."""
    return AN.run_statistics(FX.results(t))


@register("A02_failure_breakdown", """
SELECT run_id, failure_type, COUNT(*) AS n
FROM results WHERE NOT passed AND failure_type IS NOT NULL GROUP BY run_id, failure_type
""")
def a02_failure_breakdown(t):
    """A-02 failure count by (run, type)."""
    return AN.failure_breakdown(FX.results(t))


_PANEL_SQL = """
WITH agg AS (
  SELECT scenario_id, COUNT(*) AS total, SUM(CASE WHEN passed THEN 1 ELSE 0 END) AS pv
  FROM verdicts GROUP BY scenario_id),
ft AS (
  SELECT scenario_id, failure_type,
         ROW_NUMBER() OVER (PARTITION BY scenario_id ORDER BY COUNT(*) DESC, MIN(slot)) AS rn
  FROM verdicts WHERE NOT passed AND failure_type IS NOT NULL
  GROUP BY scenario_id, failure_type),
b AS (
  SELECT s.scenario_id, COALESCE(a.total, 0) AS total, COALESCE(a.pv, 0) AS p,
         COALESCE(a.total, 0) - COALESCE(a.pv, 0) AS f, ft.failure_type AS top
  FROM panel_scenarios s LEFT JOIN agg a ON a.scenario_id = s.scenario_id
  LEFT JOIN ft ON ft.scenario_id = s.scenario_id AND ft.rn = 1),
pv AS (
SELECT scenario_id,
       CASE WHEN total = 0 THEN TRUE WHEN p = f THEN FALSE ELSE p > f END AS passed,
       CAST(CASE WHEN total = 0 THEN 0.0 WHEN p = f THEN 0.33 WHEN GREATEST(p, f) = total THEN 0.95
                 WHEN GREATEST(p, f) = total - 1 THEN 0.75 ELSE 0.33 END AS DOUBLE) AS confidence,
       CASE WHEN total = 0 THEN 'no_judges' WHEN p = f THEN 'tie' WHEN GREATEST(p, f) = total THEN 'unanimous'
            WHEN GREATEST(p, f) = total - 1 THEN 'majority' ELSE 'minority' END AS agreement_level,
       (total = 0 OR p = f OR (GREATEST(p, f) <> total AND GREATEST(p, f) <> total - 1)) AS requires_human_review,
       CASE WHEN total = 0 THEN 'No judges returned verdicts'
            WHEN p = f THEN 'Judges tied — equal pass and fail votes'
            WHEN GREATEST(p, f) <> total AND GREATEST(p, f) <> total - 1 THEN 'Only minority agreement among judges'
            ELSE '' END AS human_review_reason,
       CASE WHEN total > 0 AND f > p THEN top END AS failure_type,
       CAST(p AS BIGINT) AS pass_votes, CAST(f AS BIGINT) AS fail_votes
FROM b)
"""


@register("A03_panel_verdict", _PANEL_SQL + "SELECT * FROM pv")
def a03_panel_verdict(t):
    """A-03 panel verdict per scenario, including scenarios with no verdict."""
    return J.panel_verdict(FX.verdicts(t), FX.panel_scenarios(t))


@register("P35_human_review_queue", _PANEL_SQL + "SELECT * FROM pv WHERE requires_human_review")
def p35_human_review(t):
    """P-35 panels that need a human."""
    return J.human_review_queue(J.panel_verdict(FX.verdicts(t), FX.panel_scenarios(t)))


@register("S07_judge_reply_parse", """
WITH x AS (
  SELECT reply_id, raw,
         regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS s0 FROM raw_replies),
y AS (
  SELECT reply_id, CASE WHEN starts_with(s0, '```') THEN
           regexp_replace(CASE WHEN starts_with(split_part(s0, '```', 2), 'json')
                               THEN substr(split_part(s0, '```', 2), 5) ELSE split_part(s0, '```', 2) END,
                          '^\\s+|\\s+$', '', 'g')
         ELSE s0 END AS js FROM x),
y2 AS (SELECT reply_id, CASE WHEN json_valid(js) THEN js END AS js FROM y),
z AS (
  SELECT reply_id, js, COALESCE(json_type(js) = 'OBJECT', FALSE) AS is_obj FROM y2),
w AS (
  SELECT reply_id, is_obj,
         CASE WHEN is_obj THEN json_exists(js, '$.passed') END AS has_passed,
         CASE WHEN is_obj THEN json_extract(js, '$.passed')::VARCHAR END AS passed_txt,
         CASE WHEN is_obj THEN json_exists(js, '$.confidence') END AS has_conf,
         CASE WHEN is_obj THEN TRY_CAST(json_extract_string(js, '$.confidence') AS DOUBLE) END AS conf,
         CASE WHEN is_obj THEN json_extract_string(js, '$.failure_type') END AS ft,
         CASE WHEN is_obj THEN json_extract_string(js, '$.reasoning') END AS reasoning
  FROM z),
v AS (SELECT *, is_obj AND (NOT has_conf OR conf IS NOT NULL) AS valid FROM w)
SELECT reply_id, COALESCE(valid, FALSE) AS valid,
       CASE WHEN valid THEN (CASE WHEN NOT has_passed THEN TRUE WHEN passed_txt = 'true' THEN TRUE
                                  WHEN passed_txt = 'false' THEN FALSE ELSE FALSE END) END AS passed,
       CASE WHEN valid AND ft IN ('HALLUCINATION','POLICY_VIOLATION','INCOMPLETE','WRONG_ANSWER',
                                  'CONTEXT_LOSS','ESCALATION_FAILURE') THEN ft END AS failure_type,
       CASE WHEN valid THEN (CASE WHEN has_conf THEN conf ELSE 0.75 END) END AS confidence,
       CASE WHEN valid THEN COALESCE(reasoning, '') END AS reasoning
FROM v
""")
def s07_judge_reply_parse(t):
    """S-06 + S-07: raw judge reply text -> verdict fields; malformed -> no verdict."""
    return J.parse_verdicts(FX.raw_replies(t)).drop("raw")


_RULE_SQL = """
WITH r0 AS (
  SELECT *, lower(regexp_replace(actual_response, '^\\s+|\\s+$', '', 'g')) AS low FROM responses),
rr AS (
  SELECT *, CASE WHEN actual_response IS NULL THEN NULL
                 WHEN length(low) < 5 THEN 'INCOMPLETE'
                 WHEN (contains(low, 'the and') OR contains(low, 'tion the')) AND NOT contains(input, '?') THEN 'INCOMPLETE'
                 WHEN contains(low, 'of the') OR contains(low, 'in and') THEN 'POLICY_VIOLATION' END AS rule_failure
  FROM r0)
"""


def _ruled(t):
    return J.apply_rules(FX.responses(t), prohibited_actions=PP.TEST_PROHIBITED_ACTIONS,
                         refusal_phrases=PP.TEST_REFUSAL_PHRASES)


@register("P03_rule_checks", _RULE_SQL + "SELECT scenario_id, company, rule_failure FROM rr")
def p03_rule_checks(t):
    """P-03 rule checks (short reply, refusal phrase, prohibited action) on bot replies."""
    return _ruled(t).select("scenario_id", "company", "rule_failure")


@register("P04_result_assembly", _RULE_SQL + "," + _PANEL_SQL.strip()[4:] + """
SELECT rr.scenario_id, rr.company,
       CASE WHEN rr.actual_response IS NULL OR rr.rule_failure IS NOT NULL THEN FALSE
            ELSE COALESCE(pv.passed, TRUE) END AS passed,
       CASE WHEN rr.actual_response IS NULL THEN 'INCOMPLETE'
            WHEN rr.rule_failure IS NOT NULL THEN rr.rule_failure ELSE pv.failure_type END AS failure_type,
       CASE WHEN rr.actual_response IS NULL OR rr.rule_failure IS NOT NULL THEN CAST(0.95 AS DOUBLE)
            ELSE COALESCE(pv.confidence, CAST(0.0 AS DOUBLE)) END AS confidence_score,
       CASE WHEN rr.actual_response IS NULL THEN 'ERROR: Target AI returned no response'
            ELSE rr.actual_response END AS actual_response,
       rr.latency_ms,
       CASE WHEN rr.actual_response IS NULL OR rr.rule_failure IS NOT NULL THEN 'RULE_BASED'
            ELSE 'HYBRID' END AS evaluation_method
FROM rr LEFT JOIN pv ON pv.scenario_id = rr.scenario_id
""")
def p04_result_assembly(t):
    """P-04/P-05: error row > rule hit > panel verdict, one result per scenario.
    The panel is joined only for rule-clean rows' ids (the join is on scenario_id)."""
    ruled = _ruled(t)
    panel = J.panel_verdict(FX.verdicts(t), FX.panel_scenarios(t))
    return J.assemble_results(ruled, panel).drop("input")
