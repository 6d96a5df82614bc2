"""Registered queries: dashboard figures, costs, calibration and reports
(A-29..A-39, A-41, W-08, W-09, P-09, P-13..P-15, J-11, SRC-14..SRC-16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grades as G
from ..functions.numeric import py_round_sql
from ..operators import analyze as AN
from ..operators import report as R
from ..sources import fixtures as FX
from . import params as PP
from .q_fix import _PAT, _fixes, _patterns, report_sql
from .q_learn import _JOINED, _joined
from .registry import register


@register("A29_overview", f"""
WITH d AS (SELECT * FROM runs WHERE status = 'completed')
SELECT company, CAST(SUM(total_scenarios) AS BIGINT) AS total_scenarios, CAST(SUM(total_failures) AS BIGINT) AS total_failures,
       {py_round_sql("AVG(COALESCE(pass_rate, 0.0))", 8)} AS avg_pass_rate, COUNT(*) AS runs,
       CAST(FLOOR(arg_max(pass_rate * total_scenarios, {{'c': created_at, 'r': run_id}}) + 0.5) AS BIGINT) AS latest_passed_shown
FROM d GROUP BY company
""")
def a29_overview(t):
    """A-29 overview totals over completed runs per company."""
    return R.overview(FX.runs(t))


@register("A30_dashboard_kpis", _PAT + """
, d AS (SELECT company, arg_max(run_id, {'c': created_at, 'r': run_id}) AS run_id FROM runs WHERE status = 'completed' GROUP BY company),
hf AS (SELECT run_id, COUNT(*) AS n FROM allfix WHERE priority = 'HIGH' GROUP BY run_id)
SELECT d.company, d.run_id, r.total_failures AS open_issues, r.total_scenarios AS scenarios,
       CAST(COALESCE(hf.n, 0) AS BIGINT) AS high_priority_fixes,
       CASE WHEN FLOOR(r.pass_rate * 100 + 0.5) >= 90 THEN 'A' WHEN FLOOR(r.pass_rate * 100 + 0.5) >= 80 THEN 'B'
            WHEN FLOOR(r.pass_rate * 100 + 0.5) >= 70 THEN 'C' WHEN FLOOR(r.pass_rate * 100 + 0.5) >= 60 THEN 'D' ELSE 'F' END AS grade
FROM d JOIN runs r ON r.run_id = d.run_id LEFT JOIN hf ON hf.run_id = d.run_id
""")
def a30_kpis(t):
    """A-30 KPIs of each company's latest completed run."""
    fixes, _ = _fixes(t)
    return R.dashboard_kpis(FX.runs(t), fixes)


@register("A31_issue_shares", _PAT + """
SELECT run_id, failure_type, affected_scenarios AS scenario_count,
       affected_scenarios / CAST(SUM(affected_scenarios) OVER (PARTITION BY run_id) AS DOUBLE) AS share
FROM pat
""")
def a31_issue_shares(t):
    """A-31 share of each pattern in its run's failures."""
    p = _patterns(t).withColumnRenamed("affected_scenarios", "scenario_count")
    return R.issue_shares(p)


@register("A32_facet_counts", """
SELECT run_id, 'all' AS facet, COUNT(*) AS n FROM results GROUP BY run_id
UNION ALL SELECT run_id, 'passed', COUNT(*) FROM results WHERE passed GROUP BY run_id
UNION ALL SELECT run_id, 'failed', COUNT(*) FROM results WHERE NOT passed GROUP BY run_id
UNION ALL SELECT run_id, failure_type, COUNT(*) FROM results WHERE NOT passed AND failure_type IS NOT NULL GROUP BY ALL
""")
def a32_facets(t):
    """A-32 result-browser tab counts per run in one pass."""
    return R.facet_counts(FX.results(t))


@register("A33_fix_buckets", _PAT + """
, task AS (SELECT run_id, CASE WHEN total_failures % 2 = 0 THEN 'PROMPT_ADDITION' ELSE 'GUARDRAIL_RULE' END AS done_type FROM runs)
SELECT a.run_id, fix_type, priority, COUNT(*) AS n, CAST(SUM(CASE WHEN fix_type = done_type THEN 1 ELSE 0 END) AS BIGINT) AS done
FROM allfix a JOIN task ON task.run_id = a.run_id GROUP BY ALL
""")
def a33_fix_buckets(t):
    """A-33 fixes per run by type and priority, and how many are done by the task-status table
    (here: one task done and one in progress per run)."""
    fixes, _ = _fixes(t)
    even = F.col("total_failures") % 2 == 0
    status = FX.runs(t).select("run_id", F.inline(F.array(
        F.struct(F.lit("Prompt improvement suggestion").alias("title"), F.when(even, "done").otherwise("in_progress").alias("status")),
        F.struct(F.lit("Guardrail rule suggestion").alias("title"), F.when(even, "in_progress").otherwise("done").alias("status")))))
    return R.fix_buckets(fixes, status)


@register("A34_cost_rollup", f"""
WITH g AS (SELECT run_id, 'test_run' AS stage, CAST(SUM(tokens) AS BIGINT) AS tokens FROM results GROUP BY run_id)
SELECT run_id, stage, tokens, tokens / 1000.0 * CAST(0.003 AS DOUBLE) AS cost_usd,
       {py_round_sql("tokens / 1000.0 * CAST(0.003 AS DOUBLE)", 4)} AS run_cost_usd
FROM g
""")
def a34_cost_rollup(t):
    """A-34 token cost per run and stage."""
    usage = FX.results(t).select("run_id", F.lit("test_run").alias("stage"), "tokens")
    return R.cost_rollup(usage)


@register("A35_cost_estimate", f"""
SELECT run_id, total_scenarios * 500 AS generation_tokens, total_scenarios * 900 AS judge_tokens,
       total_scenarios * 1400 AS estimated_tokens,
       {py_round_sql("total_scenarios * 1400 / 1000.0 * CAST(0.003 AS DOUBLE)", 4)} AS estimated_cost_usd,
       {py_round_sql("total_scenarios * 500 / 1000.0 * CAST(0.003 AS DOUBLE)", 4)} AS generation_cost,
       {py_round_sql("total_scenarios * 900 / 1000.0 * CAST(0.003 AS DOUBLE)", 4)} AS judge_cost
FROM runs
""")
def a35_cost_estimate(t):
    """A-35 pre-run token and cost estimate (3 judges)."""
    return R.cost_estimate(FX.runs(t).select("run_id", "total_scenarios")).drop("total_scenarios")


@register("A36_ui_cost_split", """
SELECT run_id, total_scenarios * CAST(0.002 AS DOUBLE) AS generation_cost, total_scenarios * CAST(0.007 AS DOUBLE) AS judging_cost,
       total_scenarios * CAST(0.001 AS DOUBLE) AS analysis_cost, total_scenarios * CAST(0.002 AS DOUBLE) AS fixes_cost,
       total_scenarios * CAST(0.012 AS DOUBLE) AS ui_total_cost
FROM runs
""")
def a36_ui_cost(t):
    """A-36 dashboard cost split per run."""
    return R.ui_cost_split(FX.runs(t).select("run_id", "total_scenarios")).drop("total_scenarios")


@register("A37_run_trend_summary", _JOINED + """,
g AS (SELECT company, arg_min(pass_rate, {'c': created_at, 'r': run_id}) AS first_rate,
       arg_max(pass_rate, {'c': created_at, 'r': run_id}) AS latest_rate, MAX(pass_rate) AS best_pass_rate,
       MIN(pass_rate) AS worst_pass_rate, COUNT(*) AS total_runs,
       (arg_max(pass_rate, {'c': created_at, 'r': run_id}) - arg_min(pass_rate, {'c': created_at, 'r': run_id})) * 100 AS improvement_pts
      FROM runs WHERE status = 'completed' GROUP BY company),
x AS (SELECT company, COUNT(*) AS n, SUM(CASE WHEN passed THEN 1 ELSE 0 END) / CAST(COUNT(*) AS DOUBLE) AS rate
      FROM j WHERE list_contains(tags, 'pri_1') GROUP BY company)
SELECT g.*, COALESCE(x.n, 0) AS regression_scenarios, x.rate AS regression_pass_rate FROM g LEFT JOIN x ON x.company = g.company
""")
def a37_trend(t):
    """A-37 first-to-latest improvement, best, worst and regression pass rate per company (the tables' tag ``pri_1`` marks
    the regression scenarios)."""
    joined = _joined(t).join(FX.scenarios(t).select("scenario_id", "company"), "scenario_id")
    return R.run_trend_summary(FX.runs(t), joined, tag="pri_1")


_CAL = """
SELECT {key} COUNT(*) AS labels,
       SUM(CASE WHEN human_passed AND judge_passed THEN 1 ELSE 0 END) AS tp,
       SUM(CASE WHEN NOT human_passed AND NOT judge_passed THEN 1 ELSE 0 END) AS tn,
       SUM(CASE WHEN NOT human_passed AND judge_passed THEN 1 ELSE 0 END) AS fp,
       SUM(CASE WHEN human_passed AND NOT judge_passed THEN 1 ELSE 0 END) AS fn
FROM human_labels {group}
"""


def _cal_sql(key):
    inner = _CAL.format(key=f"{key}," if key else "", group=f"GROUP BY {key}" if key else "")
    return f"""
WITH g AS ({inner}),
c AS (SELECT *, CAST(labels AS DOUBLE) AS n FROM g),
k AS (SELECT *, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n) AS pe FROM c)
SELECT {key + ',' if key else ''} labels, CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp,
       CAST(fn AS BIGINT) AS fn,
       CASE WHEN 1 - pe = 0 THEN NULL ELSE (po - pe) / (1 - pe) END AS kappa,
       CASE WHEN tp + fn = 0 THEN NULL ELSE tp / CAST(tp + fn AS DOUBLE) END AS tpr,
       CASE WHEN tn + fp = 0 THEN NULL ELSE tn / CAST(tn + fp AS DOUBLE) END AS tnr
FROM k
"""


@register("A38_judge_calibration", _cal_sql("domain"))
def a38_calibration(t):
    """A-38 judge vs human agreement per domain (kappa, TPR, TNR)."""
    return R.judge_calibration(FX.human_labels(t), "domain")


@register("A38_judge_calibration_overall", _cal_sql(None))
def a38_calibration_all(t):
    """A-38 judge vs human agreement over all labels."""
    return R.judge_calibration(FX.human_labels(t), None)


@register("J11_apply_corrections", """
SELECT result_id, judge_passed, human_passed AS final_passed, human_passed <> judge_passed AS corrected
FROM human_labels
""")
def j11_corrections(t):
    """J-11 human corrections override the judge's verdict; of the two per disagreement the later one holds."""
    hl = FX.human_labels(t)
    corr = hl.where(F.col("human_passed") != F.col("judge_passed")).select("result_id", F.inline(F.array(
        F.struct(F.col("human_passed").alias("correct_verdict"), F.lit(1).alias("corrected_at")),
        F.struct(F.col("judge_passed").alias("correct_verdict"), F.lit(0).alias("corrected_at")))))
    return R.apply_corrections(hl.select("result_id", "judge_passed"), corr).select(
        "result_id", "judge_passed", "final_passed", "corrected")


@register("A39_fix_effectiveness", _PAT + f"""
, nx AS (SELECT run_id, pass_rate, LEAD(pass_rate) OVER (PARTITION BY company ORDER BY created_at, run_id) AS next_rate
         FROM runs WHERE status = 'completed'),
j AS (SELECT a.failure_type, a.fix_type, (nx.next_rate - nx.pass_rate) * 100 AS d FROM allfix a JOIN nx ON nx.run_id = a.run_id
      WHERE nx.next_rate IS NOT NULL)
SELECT failure_type, fix_type, COUNT(*) AS fixes, AVG(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) AS success_rate,
       {py_round_sql("AVG(d)", 8)} AS mean_improvement_pts
FROM j GROUP BY ALL
""")
def a39_fix_effectiveness(t):
    """A-39 how often a fix type is followed by a better next run."""
    fixes, _ = _fixes(t)
    return R.fix_effectiveness(fixes, FX.runs(t))


@register("A41_monitoring_status", """
SELECT company, CASE WHEN bool_or(status = 'running') THEN 'running' ELSE 'active' END AS monitoring_status,
       arg_max(total_failures, {'c': created_at, 'r': run_id}) FILTER (WHERE status = 'completed') AS open_issues,
       arg_max(created_at, {'c': created_at, 'r': run_id}) FILTER (WHERE status = 'completed') AS last_scan
FROM runs GROUP BY company
""")
def a41_monitoring(t):
    """A-41 monitoring status, open issues and last scan per company."""
    return R.monitoring_status(FX.runs(t))


@register("W08_trend_series", """
SELECT company, run_id, pass_rate, CAST(point AS INT) AS point FROM (
  SELECT company, run_id, pass_rate, ROW_NUMBER() OVER (PARTITION BY company ORDER BY created_at, run_id) AS point,
         COUNT(*) OVER (PARTITION BY company) AS n
  FROM runs WHERE status = 'completed') x WHERE n >= 2
""")
def w08_trend_series(t):
    """W-08 trend points oldest to newest (companies with >= 2 runs)."""
    return R.trend_series(FX.runs(t))


@register("W09_recent_runs", """
SELECT company, run_id, CAST(pos AS INT) AS pos, pass_rate,
       CASE WHEN FLOOR(pass_rate * 100 + 0.5) >= 90 THEN 'A' WHEN FLOOR(pass_rate * 100 + 0.5) >= 80 THEN 'B'
            WHEN FLOOR(pass_rate * 100 + 0.5) >= 70 THEN 'C' WHEN FLOOR(pass_rate * 100 + 0.5) >= 60 THEN 'D' ELSE 'F' END AS grade
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY company ORDER BY created_at DESC, run_id DESC) AS pos
      FROM runs WHERE status = 'completed') x WHERE pos <= 5
""")
def w09_recent_runs(t):
    """W-09 five newest completed runs per company with grades."""
    return R.recent_runs(FX.runs(t))


_REL = f"""
CASE WHEN created_at IS NULL THEN '—'
     WHEN FLOOR(date_diff('microsecond', created_at, TIMESTAMP '{PP.REPORT_NOW}') / 60000000.0) < 1 THEN 'Just now'
     WHEN FLOOR(date_diff('microsecond', created_at, TIMESTAMP '{PP.REPORT_NOW}') / 60000000.0) < 60
          THEN CAST(CAST(FLOOR(date_diff('microsecond', created_at, TIMESTAMP '{PP.REPORT_NOW}') / 60000000.0) AS BIGINT) AS VARCHAR) || 'm ago'
     WHEN FLOOR(date_diff('microsecond', created_at, TIMESTAMP '{PP.REPORT_NOW}') / 3600000000.0) < 24
          THEN CAST(CAST(FLOOR(date_diff('microsecond', created_at, TIMESTAMP '{PP.REPORT_NOW}') / 3600000000.0) AS BIGINT) AS VARCHAR) || 'h ago'
     WHEN FLOOR(date_diff('microsecond', created_at, TIMESTAMP '{PP.REPORT_NOW}') / 86400000000.0) < 7
          THEN CAST(CAST(FLOOR(date_diff('microsecond', created_at, TIMESTAMP '{PP.REPORT_NOW}') / 86400000000.0) AS BIGINT) AS VARCHAR) || 'd ago'
     ELSE strftime(created_at, '%Y-%m-%d') END
"""


@register("P15_relative_time", f"SELECT run_id, {_REL} AS last_scan_label FROM runs")
def p15_relative_time(t):
    """P-15 relative time label of each run against a fixed 'now'."""
    r = FX.runs(t)
    return r.select("run_id", G.relative_time(F.col("created_at"), F.to_timestamp(F.lit(PP.REPORT_NOW)))
                    .alias("last_scan_label"))


@register("P09_result_filter", """
WITH sc AS (SELECT * FROM scenarios)
SELECT r.result_id, r.failure_type, sc.input
FROM results r JOIN sc ON sc.scenario_id = r.scenario_id
WHERE NOT r.passed AND (contains(lower(sc.input), 'input 4') OR contains(lower(COALESCE(r.failure_type, '')), 'input 4'))
""")
def p09_filter(t):
    """P-09 failed results whose input or type contains 'Input 4' (case-insensitive)."""
    return R.filter_results(_joined(t), "failed", query="Input 4").select("result_id", "failure_type", "input")


@register("SRC15_executive_summary", _PAT + f"""
, hf AS (SELECT run_id, COUNT(*) AS n FROM allfix WHERE priority = 'HIGH' GROUP BY run_id),
x AS (SELECT r.*, COALESCE(hf.n, 0) AS hfx, CAST(FLOOR(COALESCE(r.pass_rate, 0) * 100 + 0.5) AS BIGINT) AS pr,
             {_REL} AS rel FROM runs r LEFT JOIN hf ON hf.run_id = r.run_id)
SELECT run_id, concat_ws(chr(10), 'QUALITY MONITOR EXECUTIVE SUMMARY', 'Organization: ' || company,
  'Report Date: {PP.REPORT_NOW[:10]}', 'Monitoring Cycle: ' || rel, '',
  'QUALITY GRADE: ' || CASE WHEN pr >= 90 THEN 'A' WHEN pr >= 80 THEN 'B' WHEN pr >= 70 THEN 'C' WHEN pr >= 60 THEN 'D' ELSE 'F' END
     || ' (' || CAST(pr AS VARCHAR) || '%)',
  'Scenarios Monitored: ' || CAST(total_scenarios AS VARCHAR), 'Open Issues: ' || CAST(total_failures AS VARCHAR),
  'High Priority Actions: ' || CAST(hfx AS VARCHAR), '',
  'DEPLOYMENT VERDICT: ' || CASE WHEN pr >= 80 AND total_failures < 10 THEN 'SAFE TO DEPLOY' ELSE 'FIX BEFORE DEPLOY' END, '',
  'Quality Monitor runs continuously inside your chatbot to detect policy violations,',
  'hallucinations, and escalation failures before customers are impacted.', '',
  'For full technical details, download the complete quality report.') AS value
FROM x
""")
def src15_executive_summary(t):
    """SRC-15 executive summary text per run."""
    fixes, _ = _fixes(t)
    high = fixes.where(F.col("priority") == "HIGH").groupBy("run_id").agg(F.count(F.lit(1)).alias("high_fixes"))
    return R.executive_summary(FX.runs(t), high, F.to_timestamp(F.lit(PP.REPORT_NOW)), PP.REPORT_NOW[:10])


@register("SRC14_quality_report", report_sql(f"""
, pj AS (SELECT run_id, '[' || string_agg(CAST(json_object('type', failure_type, 'count', affected_scenarios, 'root_cause', '', 'priority', prio) AS VARCHAR),
                                         ',' ORDER BY pattern_rank) || ']' AS js, COUNT(*) AS n FROM pp GROUP BY run_id),
fj AS (SELECT run_id, '[' || string_agg(CAST(json_object('title', title, 'priority', priority, 'type', fix_type, 'problem', problem,
                                                   'suggested_fix', suggested_fix) AS VARCHAR), ',' ORDER BY fix_rank) || ']' AS js FROM told GROUP BY run_id),
z AS (SELECT r.*, y.pr AS pr4, y.failed_count, pj.js AS pjs, pj.n AS n_patterns, fj.js AS fjs, CAST(FLOOR(COALESCE(r.pass_rate, 0) * 100 + 0.5) AS BIGINT) AS pct
      FROM runs r JOIN y ON y.run_id = r.run_id LEFT JOIN pj ON pj.run_id = r.run_id LEFT JOIN fj ON fj.run_id = r.run_id)
SELECT run_id, CAST(json_object('title', 'Quality Monitor Quality Report — ' || company, 'generated_at', '{PP.REPORT_NOW}',
   'monitoring_cycle', strftime(created_at, '%Y-%m-%dT%H:%M:%S'),
   'quality_grade', CASE WHEN pct >= 90 THEN 'A' WHEN pct >= 80 THEN 'B' WHEN pct >= 70 THEN 'C' WHEN pct >= 60 THEN 'D' ELSE 'F' END,
   'pass_rate', CAST(pct AS VARCHAR) || '%', 'scenarios_monitored', total_scenarios, 'open_issues', total_failures,
   'deployment_verdict', CASE WHEN pass_rate >= 0.8 AND total_failures < 10 THEN 'SAFE TO DEPLOY' ELSE 'FIX BEFORE DEPLOY' END,
   'issue_summary', 'Analysis complete. Pass rate: ' || CAST({py_round_sql("pr4 * 100", 1)} AS VARCHAR) || '%. ' || CAST(failed_count AS VARCHAR)
        || ' failures detected across ' || CAST(COALESCE(n_patterns, 0) AS VARCHAR) || ' patterns.',
   'failure_patterns', COALESCE(pjs, '[]')::JSON, 'remediation_actions', COALESCE(fjs, '[]')::JSON,
   'disclaimer', 'Generated by Quality Monitor continuous monitoring. Review all recommendations before implementing.') AS VARCHAR) AS value
FROM z
"""))
def src14_quality_report(t):
    """SRC-14 JSON quality report per run (nested)."""
    fixes, stats = _fixes(t)
    pats = _patterns(t).withColumnRenamed("affected_scenarios", "scenario_count")
    told = AN.summary_fallback(stats, pats.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_patterns")))
    return R.quality_report_json(FX.runs(t), pats, fixes, told, PP.REPORT_NOW)


@register("SRC16_fix_finetune_lines", _PAT + """
SELECT run_id, CAST(json_object('messages', [json_object('role', 'user', 'content', '[Training input 1 — WRONG_ANSWER]'),
                                              json_object('role', 'assistant', 'content', '[Correct output — Download ' || CAST(pairs AS VARCHAR) || ' training pairs generated from your actual failures. Each pair contains the problematic input and the correct expected output. Fine-tune your open-source model on these pairs to correct the specific failure patterns found.]')],
                                 'metadata', json_object('failure_type', 'WRONG_ANSWER', 'priority', 'MEDIUM', 'run_id', run_id)) AS VARCHAR) AS value
FROM st WHERE pairs > 0
""")
def src16_fix_finetune(t):
    """SRC-16 placeholder fine-tuning JSONL lines from the fine-tuning fixes."""
    fixes, _ = _fixes(t)
    return R.fix_finetune_lines(fixes)
