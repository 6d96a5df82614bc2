"""Dashboard figures and reports over all runs at once
(A-29..A-39, A-41, W-08, W-09, P-15, SRC-14..SRC-16, J-11, P-09).

Every figure is an aggregate keyed by company / run; "latest run" is a
``max_by`` aggregate, series are windows over a company's *runs* (not its
results).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import grades as G
from ..functions.numeric import py_round


def overview(runs: DataFrame, key: str = "company") -> DataFrame:
    """A-29: completed runs per company: scenarios, failures, unweighted mean
    pass rate, run count; the latest run's passed count as round(rate * total)."""
    done = runs.where(F.col("status") == "completed")
    latest = F.max_by(F.struct("pass_rate", "total_scenarios"), F.struct("created_at", "run_id"))
    g = done.groupBy(key).agg(
        F.sum("total_scenarios").cast("bigint").alias("total_scenarios"),
        F.sum("total_failures").cast("bigint").alias("total_failures"),
        # 8 dp: a mean of doubles otherwise depends on the summation order (partitioning)
        py_round(F.avg(F.coalesce("pass_rate", F.lit(0.0))), 8).alias("avg_pass_rate"),
        F.count(F.lit(1)).alias("runs"), latest.alias("_l"))
    shown = F.floor(F.coalesce(F.col("_l.pass_rate"), F.lit(0.0)) * F.col("_l.total_scenarios") + 0.5)
    return g.select(key, "total_scenarios", "total_failures", "avg_pass_rate", "runs",
                    shown.cast("bigint").alias("latest_passed_shown"))


def dashboard_kpis(runs: DataFrame, fixes: DataFrame, key: str = "company") -> DataFrame:
    """A-30: for the latest completed run of each company: open issues,
    scenarios, HIGH fixes, grade."""
    done = runs.where(F.col("status") == "completed")
    latest = done.groupBy(key).agg(F.max_by(F.struct("run_id", "pass_rate", "total_scenarios", "total_failures"),
                                            F.struct("created_at", "run_id")).alias("r")).select(key, "r.*")
    high = fixes.where(F.col("priority") == "HIGH").groupBy("run_id").agg(F.count(F.lit(1)).alias("high_fixes"))
    j = latest.join(high, "run_id", "left")
    return j.select(key, "run_id", F.col("total_failures").alias("open_issues"),
                    F.col("total_scenarios").alias("scenarios"),
                    F.coalesce("high_fixes", F.lit(0)).cast("bigint").alias("high_priority_fixes"),
                    G.grade_letter("pass_rate").alias("grade"))


def issue_shares(patterns: DataFrame, run_col: str = "run_id") -> DataFrame:
    """A-31: each pattern's share of its run's failures (count / total)."""
    w = Window.partitionBy(run_col)
    return patterns.select(run_col, "failure_type", "scenario_count",
                           (F.col("scenario_count") / F.sum("scenario_count").over(w)).alias("share"))


def facet_counts(results: DataFrame, run_col: str = "run_id") -> DataFrame:
    """A-32: tab counts per run — all, passed, failed and one per failure type — in one pass."""
    facets = F.array_compact(F.array(
        F.lit("all"), F.when(F.col("passed"), F.lit("passed")), F.when(~F.col("passed"), F.lit("failed")),
        F.when(~F.col("passed") & F.col("failure_type").isNotNull(), F.col("failure_type"))))
    return (results.select(run_col, F.explode(facets).alias("facet"))
                   .groupBy(run_col, "facet").agg(F.count(F.lit(1)).alias("n")))


def fix_buckets(fixes: DataFrame, status: DataFrame | None = None, run_col: str = "run_id") -> DataFrame:
    """A-33: fixes per (run, fix type, priority); ``done`` from a task-status
    table (run_id, title, status) when given."""
    f = fixes
    if status is not None:
        f = f.join(status.select(run_col, "title", "status"), [run_col, "title"], "left")
    else:
        f = f.withColumn("status", F.lit(None).cast("string"))
    return f.groupBy(run_col, F.coalesce("fix_type", F.lit("OTHER")).alias("fix_type"), "priority").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "done").alias("done"))


def cost_rollup(usage: DataFrame, run_col: str = "run_id", stage_col: str = "stage") -> DataFrame:
    """A-34: tokens and cost per (run, stage) and the run total (4 dp)."""
    g = usage.groupBy(run_col, stage_col).agg(F.sum("tokens").cast("bigint").alias("tokens"))
    g = g.withColumn("cost_usd", F.col("tokens") / 1000 * F.lit(S.PRICE_PER_1K_TOKENS))
    w = Window.partitionBy(run_col)
    return g.withColumn("run_cost_usd", py_round(F.sum("cost_usd").over(w), 4))


def cost_estimate(df: DataFrame, n_col: str = "total_scenarios", judges: int = 3) -> DataFrame:
    """A-35: pre-run estimate — 500 tokens per scenario + 300 per judge call."""
    n = F.col(n_col).cast("bigint")
    gen = n * S.TOKENS_PER_SCENARIO
    jud = n * judges * S.TOKENS_PER_JUDGE_CALL
    price = F.lit(S.PRICE_PER_1K_TOKENS)
    return df.select("*", gen.alias("generation_tokens"), jud.alias("judge_tokens"),
                     (gen + jud).alias("estimated_tokens"),
                     py_round((gen + jud) / 1000 * price, 4).alias("estimated_cost_usd"),
                     py_round(gen / 1000 * price, 4).alias("generation_cost"),
                     py_round(jud / 1000 * price, 4).alias("judge_cost"))


def ui_cost_split(df: DataFrame, n_col: str = "total_scenarios") -> DataFrame:
    """A-36: dashboard cost per scenario split 0.002/0.007/0.001/0.002 (total 0.012)."""
    n = F.col(n_col)
    parts = [(n * F.lit(v)).alias(f"{k}_cost") for k, v in S.UI_COST_PER_SCENARIO.items()]
    total = n * F.lit(sum(S.UI_COST_PER_SCENARIO.values()))
    return df.select("*", *parts, total.alias("ui_total_cost"))


def run_trend_summary(runs: DataFrame, results: DataFrame | None = None, key: str = "company",
                      tag: str = "regression") -> DataFrame:
    """A-37 (schema-only in the source): first->latest improvement in points,
    best, worst and number of completed runs per company; with ``results``
    (key, tags, passed) also the number and pass rate of the results whose
    scenario carries ``tag`` (rate null without any)."""
    done = runs.where(F.col("status") == "completed")
    order = F.struct("created_at", "run_id")
    g = done.groupBy(key).agg(F.min_by("pass_rate", order).alias("first_rate"),
                              F.max_by("pass_rate", order).alias("latest_rate"),
                              F.max("pass_rate").alias("best_pass_rate"),
                              F.min("pass_rate").alias("worst_pass_rate"),
                              F.count(F.lit(1)).alias("total_runs"))
    g = g.withColumn("improvement_pts", (F.col("latest_rate") - F.col("first_rate")) * 100)
    if results is None:
        return g
    tagged = results.where(F.array_contains("tags", tag)).groupBy(key).agg(
        F.count(F.lit(1)).alias("regression_scenarios"),
        (F.count_if("passed") / F.count(F.lit(1))).alias("regression_pass_rate"))
    return g.join(tagged, key, "left").withColumn("regression_scenarios", F.coalesce("regression_scenarios", F.lit(0)))


def judge_calibration(labels: DataFrame, key: str | None = "domain") -> DataFrame:
    """A-38 (schema-only in the source): agreement of the judge with human
    labels — Cohen's kappa, TPR, TNR, label count; per key or overall."""
    h, j = F.col("human_passed"), F.col("judge_passed")
    aggs = [F.count(F.lit(1)).alias("labels"), F.count_if(h & j).alias("tp"), F.count_if(~h & ~j).alias("tn"),
            F.count_if(~h & j).alias("fp"), F.count_if(h & ~j).alias("fn")]
    g = labels.groupBy(key).agg(*aggs) if key else labels.agg(*aggs)
    n = F.col("labels").cast("double")
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    po = (tp + tn) / n
    pe = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    return g.select("*", F.try_divide(po - pe, 1 - pe).alias("kappa"),
                    F.try_divide(tp, tp + fn).alias("tpr"), F.try_divide(tn, tn + fp).alias("tnr"))


def apply_corrections(verdicts: DataFrame, corrections: DataFrame) -> DataFrame:
    """J-11 (schema-only in the source): the latest human correction of a
    result overrides the judge's verdict."""
    latest = corrections.groupBy("result_id").agg(
        F.max_by("correct_verdict", F.struct("corrected_at")).alias("correct_verdict"))
    j = verdicts.join(latest, "result_id", "left")
    return j.withColumn("final_passed", F.coalesce("correct_verdict", "judge_passed")) \
            .withColumn("corrected", F.col("correct_verdict").isNotNull())


def fix_effectiveness(fixes: DataFrame, runs: DataFrame, key: str = "company") -> DataFrame:
    """A-39 (schema-only in the source): per (failure type, fix type) the share
    of fixes followed by a better next run and the mean change in points."""
    w = Window.partitionBy(key).orderBy("created_at", "run_id")
    nxt = runs.where(F.col("status") == "completed").select(
        "run_id", key, "pass_rate", F.lead("pass_rate").over(w).alias("next_rate"))
    j = fixes.join(nxt, "run_id").where(F.col("next_rate").isNotNull())
    delta = (F.col("next_rate") - F.col("pass_rate")) * 100
    return j.groupBy("failure_type", "fix_type").agg(
        F.count(F.lit(1)).alias("fixes"), F.avg((delta > 0).cast("double")).alias("success_rate"),
        py_round(F.avg(delta), 8).alias("mean_improvement_pts"))


def monitoring_status(runs: DataFrame, key: str = "company") -> DataFrame:
    """A-41: 'running' if any run of the company is running, else 'active';
    open issues and last scan time of the newest completed run."""
    done = F.when(F.col("status") == "completed", F.struct("created_at", "run_id"))
    return runs.groupBy(key).agg(
        F.when(F.bool_or(F.col("status") == "running"), "running").otherwise("active").alias("monitoring_status"),
        F.max_by("total_failures", done).alias("open_issues"),
        F.max_by("created_at", done).alias("last_scan"))


def trend_series(runs: DataFrame, key: str = "company") -> DataFrame:
    """W-08: completed runs oldest -> newest with their position; companies with < 2 runs have none."""
    done = runs.where(F.col("status") == "completed")
    w = Window.partitionBy(key).orderBy("created_at", "run_id")
    s = done.select(key, "run_id", "pass_rate", F.row_number().over(w).alias("point"),
                    F.count(F.lit(1)).over(Window.partitionBy(key)).alias("_n"))
    return s.where(F.col("_n") >= 2).drop("_n")


def recent_runs(runs: DataFrame, key: str = "company", n: int = 5) -> DataFrame:
    """W-09: the n newest completed runs per company with their grade."""
    done = runs.where(F.col("status") == "completed")
    w = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("run_id"))
    r = done.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
    return r.select(key, "run_id", "pos", "pass_rate", G.grade_letter("pass_rate").alias("grade"))


def filter_results(results: DataFrame, status: str = "all", failure_type: str | None = None,
                   query: str | None = None, text_cols=("input", "failure_type")) -> DataFrame:
    """P-09: result browser filter — status tab, failure type, case-insensitive substring."""
    r = results
    if status == "passed":
        r = r.where(F.col("passed"))
    elif status == "failed":
        r = r.where(~F.col("passed"))
    if failure_type:
        r = r.where(F.col("failure_type") == failure_type)
    if query and query.strip():
        q = F.lit(query.lower())
        cond = None
        for c in text_cols:
            term = F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), q)
            cond = term if cond is None else (cond | term)
        r = r.where(cond)
    return r


def executive_summary(runs: DataFrame, high_fixes: DataFrame, now: Column, report_date: str,
                      product: str = S.PRODUCT) -> DataFrame:
    """SRC-15: executive summary text per run, under the name ``product``."""
    j = runs.join(high_fixes, "run_id", "left")
    pr = G.js_round_pct("pass_rate")
    safe = G.deploy_safe_rounded("pass_rate", "total_failures")
    lines = [
        F.lit(f"{product.upper()} EXECUTIVE SUMMARY"),
        F.concat(F.lit("Organization: "), F.col("company")),
        F.lit(f"Report Date: {report_date}"),
        F.concat(F.lit("Monitoring Cycle: "), G.relative_time(F.col("created_at"), now)),
        F.lit(""),
        F.concat(F.lit("QUALITY GRADE: "), G.grade_letter("pass_rate"), F.lit(" ("), pr.cast("string"), F.lit("%)")),
        F.concat(F.lit("Scenarios Monitored: "), F.col("total_scenarios").cast("string")),
        F.concat(F.lit("Open Issues: "), F.col("total_failures").cast("string")),
        F.concat(F.lit("High Priority Actions: "), F.coalesce(F.col("high_fixes"), F.lit(0)).cast("string")),
        F.lit(""),
        F.concat(F.lit("DEPLOYMENT VERDICT: "), G.deploy_verdict_text(safe)),
        F.lit(""),
        F.lit(f"{product} runs continuously inside your chatbot to detect policy violations,"),
        F.lit("hallucinations, and escalation failures before customers are impacted."),
        F.lit(""),
        F.lit("For full technical details, download the complete quality report."),
    ]
    return j.select("run_id", F.concat_ws("\n", *lines).alias("value"))


def quality_report_json(runs: DataFrame, patterns: DataFrame, fixes: DataFrame, summaries: DataFrame, generated_at: str,
                        product: str = S.PRODUCT) -> DataFrame:
    """SRC-14: one JSON quality report per run (grade, percent, verdict, issue
    summary from ``summaries`` (run_id, summary), patterns, remediation actions).  Patterns are bounded per run (one per
    cluster/type); actions are the run's fixes."""
    pats = patterns.groupBy("run_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pattern_rank", "failure_type", "scenario_count",
                                             F.coalesce("root_cause", F.lit("")).alias("root_cause"), "priority"))),
        lambda p: F.struct(p["failure_type"].alias("type"), p["scenario_count"].alias("count"),
                           p["root_cause"].alias("root_cause"), p["priority"].alias("priority")))
        .alias("failure_patterns"))
    acts = fixes.groupBy("run_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("fix_rank", "title", "priority", "fix_type", "problem",
                                             "suggested_fix"))),
        lambda f: F.struct(f["title"].alias("title"), f["priority"].alias("priority"),
                           f["fix_type"].alias("type"), f["problem"].alias("problem"),
                           f["suggested_fix"].alias("suggested_fix"))).alias("remediation_actions"))
    j = runs.join(pats, "run_id", "left").join(acts, "run_id", "left").join(summaries, "run_id", "left")
    safe = G.deploy_safe("pass_rate", "total_failures")
    report = F.struct(
        F.concat(F.lit(f"{product} Quality Report — "), F.col("company")).alias("title"),
        F.lit(generated_at).alias("generated_at"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("monitoring_cycle"),
        G.grade_letter("pass_rate").alias("quality_grade"),
        F.concat(G.js_round_pct("pass_rate").cast("string"), F.lit("%")).alias("pass_rate"),
        F.col("total_scenarios").alias("scenarios_monitored"),
        F.col("total_failures").alias("open_issues"),
        G.deploy_verdict_text(safe).alias("deployment_verdict"),
        F.coalesce("summary", F.lit("")).alias("issue_summary"),
        F.coalesce("failure_patterns", F.array()).alias("failure_patterns"),
        F.coalesce("remediation_actions", F.array()).alias("remediation_actions"),
        F.lit(f"Generated by {product} continuous monitoring. Review all recommendations before implementing.")
        .alias("disclaimer"))
    return j.select("run_id", F.to_json(report).alias("value"))


def integration_summary(stats: DataFrame, breakdown: DataFrame, patterns: DataFrame, summaries: DataFrame, fixes: DataFrame,
                        report: DataFrame, max_fixes: int | None = 10, run_col: str = "run_id") -> DataFrame:
    """A-40: one row per run with the figures, the patterns and the first
    ``max_fixes`` fixes (None: all) as JSON, the summary text and the estimate."""
    pats = patterns.groupBy(run_col).agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("pattern_rank", "cluster_label", "failure_type", "scenario_count", "root_cause",
                                             "immediate_fix", "priority"))),
        lambda p: F.struct(p["cluster_label"].alias("cluster_label"), p["failure_type"].alias("failure_type"),
                           p["scenario_count"].alias("scenario_count"), p["root_cause"].alias("root_cause"),
                           p["immediate_fix"].alias("immediate_fix"), p["priority"].alias("suggested_priority"))))
        .alias("failure_patterns"))
    first = fixes if max_fixes is None else fixes.where(F.col("fix_rank") <= max_fixes)
    acts = first.groupBy(run_col).agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("fix_rank", "title", "fix_type", "problem", "suggested_fix", "priority", "estimated_impact"))),
        lambda f: F.struct(f["title"].alias("title"), f["fix_type"].alias("fix_type"), f["problem"].alias("problem"),
                           f["suggested_fix"].alias("suggested_fix"), f["priority"].alias("priority"),
                           f["estimated_impact"].alias("estimated_impact")))).alias("fixes"))
    j = stats
    for part in (breakdown, pats, summaries, acts, report):
        j = j.join(part, run_col, "left")
    return j.select(
        run_col, "pass_rate", py_round(F.col("pass_rate") * 100, 1).alias("pass_rate_percent"),
        F.col("total").alias("total_scenarios"), F.col("passed_count").alias("passed"), F.col("failed_count").alias("failed"),
        F.coalesce("failure_breakdown", F.lit("")).alias("failure_breakdown"),
        F.coalesce("failure_patterns", F.lit("[]")).alias("failure_patterns"), F.col("summary").alias("insight_summary"),
        "total_fixes", F.col("high_priority_count").alias("high_priority_fixes"), F.coalesce("fixes", F.lit("[]")).alias("fixes"),
        "estimated_improvement")


def fix_finetune_lines(fixes: DataFrame, run_col: str = "run_id") -> DataFrame:
    """SRC-16: placeholder fine-tuning lines from a run's FINE_TUNING_DATA fixes."""
    ft = fixes.where(F.col("fix_type") == "FINE_TUNING_DATA")
    w = Window.partitionBy(run_col).orderBy("fix_rank")
    ft = ft.withColumn("_i", F.row_number().over(w))
    msg = F.array(
        F.struct(F.lit("user").alias("role"), F.concat(F.lit("[Training input "), F.col("_i").cast("string"),
                 F.lit(" — "), F.coalesce("failure_type", F.lit("failure")), F.lit("]")).alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("[Correct output — "),
                 F.coalesce("suggested_fix", F.lit("")), F.lit("]")).alias("content")))
    meta = F.struct(F.col("failure_type"), F.col("priority"), F.col(run_col).alias("run_id"))
    return ft.select(run_col, F.to_json(F.struct(msg.alias("messages"), meta.alias("metadata"))).alias("value"))
