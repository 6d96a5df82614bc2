"""Prompt tables for the model calls (PR-01, PR-06, PR-07, PR-08, PR-13).

The Spark work is the context per key — first-n examples (``row_number <= n``,
partial limit before the shuffle), ordered ``collect_list`` of at most n items,
``array_join`` — and one :func:`render` per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions.numeric import py_round
from ..functions.text import prefix


def _first_n_text(df: DataFrame, keys: list[str], order: str, text, n: int, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    top = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return top.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", text.alias("_t")))),
                                 lambda s: s["_t"]), "\n").alias(name),
        F.count(F.lit(1)).alias(f"n_{name}"))


def judge_prompts(rows: DataFrame, suffix=None) -> DataFrame:
    """PR-01: one judge prompt per scenario (the same text goes to every judge of the panel)."""
    sfx = F.lit("") if suffix is None else (F.col(suffix) if isinstance(suffix, str) else suffix)
    return rows.withColumn("prompt", P.render(P.JUDGE_PROMPT, input="input", expected_behavior="expected_behavior",
                                              response="actual_response", suffix=sfx))


def cluster_label_prompts(failed: DataFrame, patterns: DataFrame, keys: list[str], company_col: str = "company",
                          order: str = "seq") -> DataFrame:
    """PR-06: per pattern: size, dominant type, share and the first 5 examples."""
    ex = _first_n_text(failed, keys, order, F.concat(F.lit("- Input: "), prefix("actual_response", 150)), 5,
                       "examples")
    j = patterns.join(ex, keys, "left")
    return j.withColumn("prompt", P.render(P.CLUSTER_LABEL_PROMPT, company=company_col, size="scenario_count",
                                           failure_type="failure_type", pct="pct_of_failures",
                                           examples=F.coalesce("examples", F.lit(""))))


def contrast_prompts(results: DataFrame, key: str, order: str = "seq", company_col: str = "company") -> DataFrame:
    """PR-07: first 10 failed vs first 10 passed responses per run; only runs with both."""
    line = F.concat(F.lit("- "), prefix("actual_response", 100))
    f = _first_n_text(results.where(~F.col("passed")), [key], order, line, 10, "failed_text")
    p = _first_n_text(results.where(F.col("passed")), [key], order, line, 10, "passed_text")
    comp = results.groupBy(key).agg(F.first(company_col).alias("_company"))
    j = f.join(p, key).join(comp, key)
    return j.select(key, P.render(P.CONTRAST_PROMPT, company="_company", n_failed="n_failed_text",
                                  failed_text="failed_text", n_passed="n_passed_text",
                                  passed_text="passed_text").alias("prompt"))


def summary_prompts(stats: DataFrame, patterns: DataFrame, key: str, company_col: str = "company") -> DataFrame:
    """PR-08: executive-summary prompt per run from A-01 stats, the first 5
    patterns and the trend line (W-06) when a previous run exists."""
    line = F.concat(F.lit("- "), F.col("cluster_label"), F.lit(": "), F.col("scenario_count").cast("string"), F.lit(" failures ("),
                    F.col("pct_of_failures").cast("string"), F.lit("%) — "), prefix("root_cause", 80))
    pt = _first_n_text(patterns, [key], "pattern_rank", line, 5, "patterns_text")
    j = stats.join(pt, key, "left")
    trend = F.coalesce(F.concat(F.lit("\n"), F.col("trend_text")), F.lit("")) if "trend_text" in stats.columns \
        else F.lit("")
    contrast = F.coalesce(F.when(F.col("contrast") != "", F.col("contrast")), F.lit("Not available")) \
        if "contrast" in stats.columns else F.lit("Not available")
    return j.select(key, P.render(
        P.SUMMARY_PROMPT, company=company_col, pass_pct=py_round(F.col("pass_rate") * 100, 1), total="total",
        passed="passed_count", failed="failed_count", trend_text=trend,
        patterns_text=F.coalesce("patterns_text", F.lit("No significant patterns detected")),
        contrast=contrast).alias("prompt"))


def improvement_prompts(report: DataFrame, stats: DataFrame, key: str, company_col: str = "company") -> DataFrame:
    """PR-13: improvement-estimate prompt per run from the A-27/A-28 numbers;
    a run without patterns has no fixes and is not asked about."""
    j = report.where("total_fixes > 0").join(stats, key)
    return j.select(key, P.render(
        P.IMPROVEMENT_PROMPT, company=company_col, current_pct=py_round(F.col("pass_rate") * 100, 1),
        n_fixes="total_fixes", n_high="high_priority_count", high_scenarios="high_priority_scenarios",
        failures="failed_count").alias("prompt"))


def fix_prompts(fixes: DataFrame) -> DataFrame:
    """PR-09..PR-12: the request text of each planned fix, by fix type.

    ``fixes`` carries the pattern (failure_type, cluster_label, scenario_count,
    root_cause, evidence, examples array) and the system's context columns
    (company, system_type, policy_context, retrieval_context)."""
    ex = F.array_join(F.transform(F.slice(F.coalesce("examples", F.array().cast("array<string>")), 1, 3),
                                  lambda e: F.concat(F.lit("- "), F.substring(e, 1, 100))), "\n")
    sys_text = F.replace(F.lower("system_type"), F.lit("_"), F.lit(" "))
    pol = F.when(F.coalesce(F.col("policy_context"), F.lit("")) != "",
                 F.concat(F.lit("KNOWN POLICIES:\n"), F.col("policy_context"))).otherwise(F.lit(""))
    ret = F.when(F.coalesce(F.col("retrieval_context"), F.lit("")) != "",
                 F.concat(F.lit("CURRENT RETRIEVAL CONFIG:\n"), F.col("retrieval_context"))).otherwise(F.lit(""))
    common = dict(failure_type="failure_type", root_cause="root_cause", evidence="evidence")
    ft = F.col("fix_type")
    prompt = (F.when(ft == "PROMPT_ADDITION", P.render(
                  P.PROMPT_FIX_PROMPT, system_type=sys_text, company="company", cluster_label="cluster_label",
                  scenario_count="scenario_count", examples=ex, policy_block=pol, **common))
               .when(ft == "GUARDRAIL_RULE", P.render(P.GUARDRAIL_FIX_PROMPT, company="company", examples=ex,
                                                      **common))
               .when(ft == "ARCHITECTURE_CHANGE", P.render(P.ARCHITECTURE_FIX_PROMPT, retrieval_block=ret, **common))
               .when(ft == "POLICY_CLARIFICATION", P.render(P.POLICY_FIX_PROMPT, company="company", examples=ex,
                                                            **common)))
    return fixes.withColumn("prompt", prompt)


def _ordered_join(df: DataFrame, keys: list[str], pos: str, text, sep: str, name: str) -> DataFrame:
    """Texts of a bounded group (a batch of <= 20) joined in position order."""
    return df.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("_p"), text.alias("_t")))),
                                 lambda s: s["_t"]), sep).alias(name),
        F.count(F.lit(1)).alias(f"n_{name}"))


def critic_prompts(batches: DataFrame, keys: list[str], deployment_col: str = "deployment") -> DataFrame:
    """PR-04: one critic request per batch: numbered scenario list and the
    pre/post-deployment evaluation context."""
    item = F.concat(F.lit("Scenario "), F.col("pos").cast("string"), F.lit(":\nInput: "), F.col("input"),
                    F.lit("\nExpected: "), F.col("expected_behavior"), F.lit("\nDifficulty: "), F.col("difficulty"))
    lst = _ordered_join(batches, keys + [deployment_col], "pos", item, "\n\n", "scenario_list")
    ctx = F.when(F.col(deployment_col) == "PRE_DEPLOYMENT", F.lit(P.CRITIC_CONTEXT_PRE)).otherwise(
        F.lit(P.CRITIC_CONTEXT_POST))
    return lst.select(*keys, P.render(P.CRITIC_PROMPT, evaluation_context=ctx, n="n_scenario_list",
                                      scenario_list="scenario_list").alias("prompt"))


def regenerate_prompts(rejected: DataFrame, keys: list[str]) -> DataFrame:
    """PR-05: one regenerate request per batch with its rejected scenarios and
    the non-empty feedback lines (numbered by rejection order)."""
    item = F.concat(F.col("pos").cast("string"), F.lit(". Input: "), F.col("input"))
    fb = F.when(F.col("feedback") != "", F.concat(F.lit("Scenario "), F.col("pos").cast("string"),
                                                  F.lit(" feedback: "), F.col("feedback")))
    lst = _ordered_join(rejected, keys, "pos", item, "\n", "scenario_list")
    fbs = rejected.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("pos").alias("_p"), fb.alias("_t")))), lambda s: s["_t"]), "\n")
        .alias("feedback"))
    j = lst.join(fbs, keys)
    return j.select(*keys, P.render(P.REGENERATE_PROMPT, scenario_list="scenario_list", feedback="feedback",
                                    n="n_scenario_list").alias("prompt"))
