"""Fix recommendations per run (J-12, S-12, L-04, K-02, A-27, A-28, J-02).

Patterns are one row per (run, pattern); every operator here is a
projection, an ``explode`` of a fixed-size array, or an aggregate keyed by
run_id.  Ordering within a run is a window over that run's fixes only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.grades import default_priority, priority_rank
from ..functions.numeric import py_round
from ..functions.text import strip_fence

_FIX_ORDER = {"PROMPT_ADDITION": 0, "GUARDRAIL_RULE": 1, "ARCHITECTURE_CHANGE": 2,
              "POLICY_CLARIFICATION": 3, "FINE_TUNING_DATA": 4}


def fix_plan(patterns: DataFrame, system_type_col: str = "system_type") -> DataFrame:
    """J-12: one row per (pattern, applicable fix type).  Prompt addition and
    guardrail always; architecture change for RAG systems (MEDIUM); policy
    clarification for POLICY_VIOLATION patterns (HIGH)."""
    prio = default_priority(F.col("failure_type"))
    cands = F.array(
        F.struct(F.lit("PROMPT_ADDITION").alias("fix_type"), prio.alias("priority")),
        F.struct(F.lit("GUARDRAIL_RULE").alias("fix_type"), prio.alias("priority")),
        F.when(F.col(system_type_col) == "RAG",
               F.struct(F.lit("ARCHITECTURE_CHANGE").alias("fix_type"), F.lit("MEDIUM").alias("priority"))),
        F.when(F.col("failure_type") == "POLICY_VIOLATION",
               F.struct(F.lit("POLICY_CLARIFICATION").alias("fix_type"), F.lit("HIGH").alias("priority"))),
    )
    out = patterns.select("*", F.explode(F.array_compact(cands)).alias("_f"))
    return out.select(*patterns.columns, F.col("_f.fix_type").alias("fix_type"),
                      F.col("_f.priority").alias("priority_fix")).drop("priority") \
        .withColumnRenamed("priority_fix", "priority")


def apply_fix_replies(plan: DataFrame, replies: DataFrame | None = None,
                      keys: tuple[str, ...] = ("run_id", "pattern_rank", "fix_type")) -> DataFrame:
    """S-12: merge the model's reply (JSON, possibly fenced) into each planned
    fix with per-type defaults (empty lists of implementation steps and
    verification scenarios); a malformed reply drops the fix.  Without
    replies every fix keeps its defaults."""
    titles = F.create_map(*[F.lit(x) for kv in S.FIX_DEFAULT_TITLE.items() for x in kv])
    discl = F.create_map(*[F.lit(x) for kv in S.FIX_DISCLAIMER.items() for x in kv])
    p = plan
    if replies is not None:
        p = p.join(replies.select(*keys, "raw"), list(keys), "left")
        js = strip_fence(F.col("raw"))
        ok = F.col("raw").isNull() | F.json_object_keys(js).isNotNull()
        p = p.where(ok).withColumn("_js", js)
    else:
        p = p.withColumn("_js", F.lit(None).cast("string"))

    def field(name, default):
        return F.coalesce(F.get_json_object("_js", f"$.{name}"), default)

    def texts(name):
        return F.coalesce(F.from_json(F.get_json_object("_js", f"$.{name}"), "array<string>"), F.array().cast("array<string>"))

    root = F.col("root_cause") if "root_cause" in plan.columns else F.lit("")
    return p.select(
        *[c for c in plan.columns],
        field("title", F.try_element_at(titles, F.col("fix_type"))).alias("title"),
        field("problem", root).alias("problem"),
        field("suggested_fix", F.lit("")).alias("suggested_fix"),
        texts("implementation_steps").alias("implementation_steps"),
        texts("verification_scenarios").alias("verification_scenarios"),
        field("estimated_impact", F.lit("")).alias("estimated_impact"),
        F.try_element_at(discl, F.col("fix_type")).alias("disclaimer"),
    )


def fine_tuning_fix(pair_counts: DataFrame, stats: DataFrame, run_col: str = "run_id", product: str = S.PRODUCT) -> DataFrame:
    """L-04: a MEDIUM fine-tuning fix per run with at least one training pair,
    with its steps and checks (under the name ``product``)."""
    def texts(lines):
        return F.array(*[F.lit(x.format(product=product)) for x in lines])
    j = pair_counts.where(F.col("pairs") > 0).join(stats.select(run_col, "failed_count"), run_col)
    n = F.col("pairs").cast("string")
    return j.select(
        run_col, F.lit("all_failures").alias("failure_pattern"), F.lit("WRONG_ANSWER").alias("failure_type"),
        F.col("failed_count").alias("affected_scenarios"), F.lit("FINE_TUNING_DATA").alias("fix_type"),
        F.lit("MEDIUM").alias("priority"), F.concat(n, F.lit(" Training Pairs Available")).alias("title"),
        F.lit(S.FINE_TUNING_PROBLEM).alias("problem"),
        F.concat(F.lit("Download "), n, F.lit(" training pairs generated from your actual failures. Each pair "
                 "contains the problematic input and the correct expected output. Fine-tune your open-source "
                 "model on these pairs to correct the specific failure patterns found.")).alias("suggested_fix"),
        texts(S.FINE_TUNING_STEPS).alias("implementation_steps"), texts(S.FINE_TUNING_CHECKS).alias("verification_scenarios"),
        F.concat(F.lit("On-policy learning from "), n, F.lit(" real failure cases may significantly improve "
                 "pass rate for open-source models")).alias("estimated_impact"),
        F.lit(S.FIX_DISCLAIMER["FINE_TUNING_DATA"]).alias("disclaimer"))


def order_fixes(fixes: DataFrame, run_col: str = "run_id") -> DataFrame:
    """K-02: HIGH, MEDIUM, LOW, then affected scenarios desc; ties keep the
    generation order (pattern order, then fix type order, fine-tuning last)."""
    ft = F.create_map(*[F.lit(x) for kv in _FIX_ORDER.items() for x in kv])
    w = Window.partitionBy(run_col).orderBy(
        priority_rank("priority"), F.desc("affected_scenarios"),
        F.coalesce(F.col("pattern_rank"), F.lit(1 << 30)), F.try_element_at(ft, F.col("fix_type")))
    return fixes.withColumn("fix_rank", F.row_number().over(w))


def fix_report(fixes: DataFrame, stats: DataFrame, run_col: str = "run_id") -> DataFrame:
    """A-27 + A-28: fix counts by priority and the deterministic improvement
    estimate (HIGH fixes' affected scenarios, capped at the failures)."""
    agg = fixes.groupBy(run_col).agg(
        F.count(F.lit(1)).alias("total_fixes"),
        F.count_if(F.col("priority") == "HIGH").alias("high_priority_count"),
        F.count_if(F.col("priority") == "MEDIUM").alias("medium_priority_count"),
        F.count_if(F.col("priority") == "LOW").alias("low_priority_count"),
        F.sum(F.when(F.col("priority") == "HIGH", F.col("affected_scenarios")).otherwise(0))
        .cast("bigint").alias("high_priority_scenarios"))
    j = stats.join(agg, run_col, "left").fillna(0, ["total_fixes", "high_priority_count",
                                                   "medium_priority_count", "low_priority_count",
                                                   "high_priority_scenarios"])
    potential = F.least(F.col("high_priority_scenarios"), F.col("failed_count"))
    new_fail = F.greatest(F.lit(0), F.col("failed_count") - potential)
    cur = py_round(F.col("pass_rate") * 100, 1)
    new = py_round((F.col("total") - new_fail) / F.col("total") * 100, 1)
    text = (F.when(F.col("total") == 0, F.lit("No scenarios tested."))
             .when(F.col("total_fixes") == 0, F.lit(S.NO_FAILURES_ESTIMATE))
             .otherwise(F.concat(F.lit("Implementing "), F.col("high_priority_count").cast("string"),
                                 F.lit(" high priority fixes may improve pass rate from "), cur.cast("string"),
                                 F.lit("% to an estimated "), new.cast("string"),
                                 F.lit("%. Results depend on implementation quality."))))
    return j.select(run_col, "total_fixes", "high_priority_count", "medium_priority_count",
                    "low_priority_count", "high_priority_scenarios",
                    F.when(F.col("total") > 0, new).alias("estimated_new_pass_pct"),
                    text.alias("estimated_improvement"))


def issues(results: DataFrame, patterns: DataFrame, run_col: str = "run_id") -> DataFrame:
    """J-02: failed results with the pattern of their failure type.  When a
    type has several patterns the *last* one in pattern order wins (the
    smallest, as patterns are sorted by size); default priority MEDIUM."""
    last = patterns.groupBy(run_col, "failure_type").agg(
        F.max_by(F.struct(*[c for c in ("cluster_label", "root_cause", "priority") if c in patterns.columns]),
                 F.col("pattern_rank")).alias("p"))
    f = results.where(~F.col("passed"))
    j = f.join(last, [run_col, "failure_type"], "left")
    return j.select(*f.columns, F.coalesce(F.col("p.priority"), F.lit("MEDIUM")).alias("issue_priority"),
                    *([F.col("p.cluster_label").alias("pattern_label")]
                      if "cluster_label" in patterns.columns else []))
