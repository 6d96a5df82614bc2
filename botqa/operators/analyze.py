"""Run analysis: statistics, breakdowns, failure patterns, trends
(A-01, A-02, A-04..A-08, C-03, K-01, W-05, W-06, PR-08 fallback).

All operators work on many runs at once; the run id is the grouping key.
Aggregations are partial+final hash aggregates; the only windows run over
*aggregated* rows (patterns per run, runs per system), never over raw results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.grades import default_priority
from ..functions.numeric import py_round
from ..functions.text import prefix


def run_statistics(results: DataFrame, run_col: str = "run_id") -> DataFrame:
    """A-01: total, passed, failed, pass rate (4 dp), mean latency (2 dp), mean confidence (4 dp)."""
    g = results.groupBy(run_col).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("passed")).alias("passed_count"),
        F.sum("latency_ms").alias("_lat"),
        F.sum("confidence_score").alias("_conf"),
    )
    return g.select(
        run_col, "total", "passed_count",
        (F.col("total") - F.col("passed_count")).alias("failed_count"),
        py_round(F.col("passed_count") / F.col("total"), 4).alias("pass_rate"),
        py_round(F.col("_lat") / F.col("total"), 2).alias("avg_latency_ms"),
        py_round(F.col("_conf") / F.col("total"), 4).alias("avg_confidence"),
    )


def failure_breakdown(results: DataFrame, run_col: str = "run_id") -> DataFrame:
    """A-02: (run, failure_type, n) over failed results with a type."""
    return (results.where(~F.col("passed") & F.col("failure_type").isNotNull())
                   .groupBy(run_col, "failure_type").agg(F.count(F.lit(1)).alias("n")))


def breakdown_text(breakdown: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Failure breakdown per run as ``TYPE:n,TYPE:n`` (types sorted) and as a map.
    At most one entry per failure type (a closed enum) — bounded per run."""
    return breakdown.groupBy(run_col).agg(
        F.array_join(F.array_sort(F.collect_list(
            F.concat(F.col("failure_type"), F.lit(":"), F.col("n").cast("string")))), ",")
        .alias("failure_breakdown"),
        F.map_from_entries(F.collect_list(F.struct("failure_type", "n"))).alias("breakdown_map"))


def clustering_gate(failed: DataFrame, run_col: str = "run_id",
                    min_failures: int = S.MIN_FAILURES_FOR_CLUSTERING) -> DataFrame:
    """C-03: per run, number of failures and whether clustering runs (>= 5)."""
    return (failed.groupBy(run_col).agg(F.count(F.lit(1)).alias("failures"))
                  .withColumn("clustered", F.col("failures") >= min_failures))


def _type_key():
    return F.coalesce(F.col("failure_type"), F.lit("UNKNOWN"))


def _pattern_type(key):
    return F.when(key.isin(S.FAILURE_TYPES), key).otherwise(F.lit("WRONG_ANSWER"))


def _examples(df: DataFrame, keys: list[str], seq_col: str, n: int) -> DataFrame:
    """W-05: first n example prefixes per group in input order.

    ``row_number() <= n`` gets a map-side WindowGroupLimit before the shuffle,
    so a hot group ships only n rows per map task."""
    if "actual_response" not in df.columns:  # no reply text carried: no examples
        return df.select(*keys).distinct().withColumn("examples", F.array().cast("array<string>"))
    w = Window.partitionBy(*keys).orderBy(seq_col)
    top = (df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
             .select(*keys, "_rn", prefix("actual_response", S.EXAMPLE_PREFIX_CHARS).alias("_ex")))
    return top.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_ex"))), lambda s: s["_ex"])
        .alias("examples"))


def patterns_by_type(failed: DataFrame, run_col: str = "run_id", seq_col: str = "seq",
                     noise: bool = False, only: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """A-05 (clustering skipped) and A-06 (noise points): one pattern per
    failure type of a run; a null type is keyed ``UNKNOWN`` and labelled
    WRONG_ANSWER.  Sorted by size (K-01), ties by first appearance.

    ``only``: the failures that form patterns; shares are of all failures of the
    run.  ``carry``: columns that depend on the run alone, kept beside the
    pattern.  One aggregate over the failures; totals and ranks are windows
    over it."""
    f, only = failed.withColumn("_key", _type_key()), F.lit(True) if only is None else only
    out = f.groupBy(run_col, "_key").agg(F.count(F.lit(1)).alias("_all"), F.count_if(only).alias("scenario_count"),
                                         F.min(F.when(only, F.col(seq_col))).alias("_first"), *[F.min(c).alias(c) for c in carry])
    out = out.withColumn("_total", F.sum("_all").over(Window.partitionBy(run_col))).where("scenario_count > 0")
    if "actual_response" in failed.columns:
        out = out.join(_examples(f.where(only), [run_col, "_key"], seq_col, S.PATTERN_EXAMPLES), [run_col, "_key"])
    else:  # no reply text carried: no examples
        out = out.withColumn("examples", F.array().cast("array<string>"))
    ptype = _pattern_type(F.col("_key"))
    out = out.select(
        run_col, F.col("_key").alias("type_key"), ptype.alias("failure_type"), "scenario_count",
        py_round(F.col("scenario_count") / F.col("_total") * 100, 1).alias("pct_of_failures"),
        "examples", default_priority(ptype).alias("priority"), "_first", *carry)
    if noise:
        out = (out.withColumn("root_cause", F.concat(F.lit("Isolated "), F.col("type_key"),
                                                     F.lit(" failures — unique cases")))
                  .withColumn("evidence", F.concat(F.col("scenario_count").cast("string"),
                                                   F.lit(" individual failures of this type")))
                  .withColumn("immediate_fix", F.lit(S.NOISE_FIX))
                  .withColumn("cluster_label", F.lit("noise")))
    w = Window.partitionBy(run_col).orderBy(F.desc("scenario_count"), "_first")
    return out.withColumn("pattern_rank", F.row_number().over(w)).drop("_first")


def dominant_type(df: DataFrame, keys: list[str], seq_col: str = "seq") -> DataFrame:
    """A-04: most common failure type of a group, ties to the first seen; no
    typed row -> WRONG_ANSWER.  Two-level aggregate (group,type) -> group;
    ``max_by`` over (count, -first) — never ``mode()`` whose ties are unspecified."""
    typed = df.where(F.col("failure_type").isNotNull())
    c = typed.groupBy(*keys, "failure_type").agg(F.count(F.lit(1)).alias("_n"),
                                                 F.min(seq_col).alias("_first"))
    top = c.groupBy(*keys).agg(
        F.max_by("failure_type", F.struct(F.col("_n"), -F.col("_first"))).alias("_dom"))
    allk = df.select(*keys).distinct()
    return allk.join(top, keys, "left").select(
        *keys, _pattern_type(F.coalesce(F.col("_dom"), F.lit("WRONG_ANSWER"))).alias("dominant_type"))


def cluster_patterns(failed: DataFrame, run_col: str = "run_id", cluster_col: str = "cluster",
                     seq_col: str = "seq") -> DataFrame:
    """A-07: one row per (run, cluster >= 0): size, share of the run's
    failures (1 dp), three example prefixes, dominant type, priority."""
    clustered = failed.where(F.col(cluster_col) >= 0)
    totals = failed.groupBy(run_col).agg(F.count(F.lit(1)).alias("_total"))
    g = clustered.groupBy(run_col, cluster_col).agg(F.count(F.lit(1)).alias("scenario_count"),
                                                    F.min(seq_col).alias("_first"))
    dom = dominant_type(clustered, [run_col, cluster_col], seq_col)
    ex = _examples(clustered, [run_col, cluster_col], seq_col, S.PATTERN_EXAMPLES)
    out = (g.join(totals, run_col).join(dom, [run_col, cluster_col]).join(ex, [run_col, cluster_col]))
    return out.select(
        run_col, cluster_col, F.col("dominant_type").alias("failure_type"), "scenario_count",
        py_round(F.col("scenario_count") / F.col("_total") * 100, 1).alias("pct_of_failures"),
        "examples", default_priority(F.col("dominant_type")).alias("priority"), "_first")


def failure_patterns(labelled: DataFrame, run_col: str = "run_id", cluster_col: str = "cluster",
                     seq_col: str = "seq") -> DataFrame:
    """A-05 + A-06 + A-07 + K-01: the pattern table of every run.  Clusters
    (>= 0) give a pattern each (to be labelled, S-11), noise (-1) one per
    failure type, and failures without a cluster (runs below the gate, C-03)
    one per failure type too.  By size; ties: clusters before noise, then by
    first appearance."""
    label = F.col(cluster_col)
    texts = ("cluster_label", "root_cause", "evidence", "immediate_fix")
    none = {c: F.lit(None).cast("string") for c in ("type_key", *texts)}
    columns = [run_col, cluster_col, "type_key", "failure_type", "scenario_count", "pct_of_failures", "examples", "priority",
               *texts, "_kind", "_first"]
    real = cluster_patterns(labelled, run_col, cluster_col, seq_col).withColumns({**none, "_kind": F.lit(0)})
    place = F.col("pattern_rank").cast("bigint")
    noise = patterns_by_type(labelled, run_col, seq_col, noise=True, only=label == -1).withColumns(
        {cluster_col: F.lit(-1), "_kind": F.lit(1), "_first": place})
    rest = patterns_by_type(labelled, run_col, seq_col, only=label.isNull()).withColumns(
        {**{c: none[c] for c in texts[1:]}, "cluster_label": F.lower("type_key"), cluster_col: F.lit(None).cast("int"),
         "_kind": F.lit(1), "_first": place})
    out = real.select(columns).unionByName(noise.select(columns)).unionByName(rest.select(columns))
    w = Window.partitionBy(run_col).orderBy(F.desc("scenario_count"), "_kind", "_first")
    return out.withColumn("pattern_rank", F.row_number().over(w)).drop("_kind", "_first")


def cluster_counts(failed: DataFrame, run_col: str = "run_id", cluster_col: str = "cluster") -> DataFrame:
    """A-08: clusters found (noise excluded) and noise size per run."""
    return failed.groupBy(run_col).agg(
        F.count_distinct(F.when(F.col(cluster_col) >= 0, F.col(cluster_col))).alias("clusters_found"),
        F.count_if(F.col(cluster_col) == -1).alias("noise_failures"))


def run_trend(runs: DataFrame, key_col: str = "company", order_col: str = "created_at") -> DataFrame:
    """W-06: delta vs the previous run of the same system; text as in the summary."""
    w = Window.partitionBy(key_col).orderBy(order_col, "run_id")
    prev = F.lag("pass_rate").over(w)
    r = runs.withColumn("prev_pass_rate", prev)
    delta = F.col("pass_rate") - F.col("prev_pass_rate")
    direction = F.when(delta > 0, "improved").otherwise("declined")
    text = F.when(F.col("prev_pass_rate").isNotNull(), F.concat(
        F.lit("TREND: Pass rate "), direction, F.lit(" by "),
        F.abs(py_round(delta * 100, 1)).cast("string"), F.lit("% vs previous run ("),
        py_round(F.col("prev_pass_rate") * 100, 1).cast("string"), F.lit("% → "),
        py_round(F.col("pass_rate") * 100, 1).cast("string"), F.lit("%)")))
    return r.select("*", delta.alias("delta"),
                    F.when(F.col("prev_pass_rate").isNotNull(), direction).alias("direction"),
                    text.alias("trend_text"))


def summary_fallback(stats: DataFrame, pattern_counts: DataFrame, run_col: str = "run_id") -> DataFrame:
    """PR-08 deterministic fallback text of the executive summary."""
    s = stats.join(pattern_counts, run_col, "left")
    return s.select(run_col, F.concat(
        F.lit("Analysis complete. Pass rate: "), py_round(F.col("pass_rate") * 100, 1).cast("string"),
        F.lit("%. "), F.col("failed_count").cast("string"), F.lit(" failures detected across "),
        F.coalesce(F.col("n_patterns"), F.lit(0)).cast("string"), F.lit(" patterns.")).alias("summary"))
