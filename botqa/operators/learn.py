"""Learning state across runs (P-19, J-01, J-04, A-18..A-23, W-07, L-01..L-05).

State is held as tables keyed by ``system_hash`` and merged by union +
aggregate (no row-by-row updates), so one pass folds any number of runs.
Every "first per key" choice is a ``min_by`` aggregate (partial + final, so
a key holding a third of all rows is still combined map-side), never a
window over the raw key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import sorted_tag_key

HIGH_VALUE_RATE = 0.40          # persona: rate >= 0.40 -> high_value
RETIRE_RATE = 0.05              # persona: rate <= 0.05 and >= 5 uses -> retired
RETIRE_MIN_USES = 5
HIGH_VALUE_PATTERN_RATE = 0.3   # scenario pattern worth re-using
WEIGHT_STEP = 0.5
WEIGHT_CAP = 3.0
FOUND_PATTERNS = 10             # patterns of the latest run that a strategy remembers


def system_hash(system_type, company_name, industry=None, max_refund=None,
                return_window=None, tolerance=None) -> Column:
    """P-19: first 16 hex chars of sha256 over six ``|``-joined fields.

    Canonical form (ours): each field as its string cast, a missing field as
    ``''`` — ``coalesce`` first because ``concat_ws`` would skip nulls and
    shift the fields."""
    def s(x):
        if x is None:
            return F.lit("")
        c = F.col(x) if isinstance(x, str) else x
        return F.coalesce(c.cast("string"), F.lit(""))
    raw = F.concat_ws("|", s(system_type), s(company_name), s(industry), s(max_refund),
                      s(return_window), s(tolerance))
    return F.substring(F.sha2(raw, 256), 1, 16)


def join_results_scenarios(results: DataFrame, scenarios: DataFrame) -> DataFrame:
    """J-01: results with their scenario (inner; results without scenario are skipped).
    Both sides are large: a shuffled equi-join on scenario_id (AQE switches
    to broadcast only when a side turns out small at runtime)."""
    sc = scenarios.select("scenario_id", "system_type", "input", "expected_behavior",
                          "difficulty", "tags", *[c for c in ("system_hash",) if c in scenarios.columns])
    res_cols = [c for c in results.columns if c not in sc.columns or c == "scenario_id"]
    return results.select(*res_cols).join(sc, "scenario_id", "inner")


def effectiveness_events(joined: DataFrame) -> DataFrame:
    """Pattern of each (result, scenario) pair: sorted tags joined by ``|``, or
    the difficulty when there are no tags (S-15)."""
    has_tags = F.col("tags").isNotNull() & (F.size("tags") > 0)
    return joined.select(
        "system_hash", "system_type",
        F.when(has_tags, sorted_tag_key("tags")).otherwise(F.col("difficulty")).alias("pattern"),
        (~F.col("passed")).alias("found_failure"),
        *[c for c in ("seq",) if c in joined.columns])


def episodic_memory(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """A-20/A-21: (times_used, failures) per (system_hash, pattern, system_type);
    failure_rate derived.  Merging an old state is union + aggregate (T3:
    keyed on pattern *and* system type)."""
    new = events.groupBy("system_hash", "pattern", "system_type").agg(
        F.count(F.lit(1)).alias("times_used"), F.count_if("found_failure").alias("failures"),
        *([F.min("seq").alias("first_seq")] if "seq" in events.columns else []))
    if state is not None:
        new = new.unionByName(state.select(*new.columns)).groupBy(
            "system_hash", "pattern", "system_type").agg(
            F.sum("times_used").alias("times_used"), F.sum("failures").alias("failures"),
            *([F.min("first_seq").alias("first_seq")] if "first_seq" in new.columns else []))
    return new.withColumn("failure_rate", F.col("failures") / F.col("times_used"))


def high_value_patterns(effectiveness: DataFrame, k: int = 10,
                        min_rate: float = HIGH_VALUE_PATTERN_RATE) -> DataFrame:
    """A-19: patterns with failure_rate >= 0.3, best k per system (rate desc,
    then first appearance)."""
    hv = effectiveness.where(F.col("failures") >= F.col("times_used") * min_rate)
    w = Window.partitionBy("system_hash").orderBy(F.desc("failure_rate"), "first_seq")
    return hv.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def regression_candidates(joined: DataFrame, library: DataFrame | None = None,
                          run_date_col: str = "created_at") -> DataFrame:
    """J-04 + L-01: every failed, typed result becomes a HARD regression
    scenario unless its input is already in the system's library; within
    the batch the first failing result per input wins.

    ``min_by(struct, seq)`` per (system, input) is a hash aggregate — no
    window over a possibly huge input group.  The anti-join against the
    library is a shuffled join on (system_hash, input)."""
    f = joined.where(~F.col("passed") & F.col("failure_type").isNotNull())
    first = f.groupBy("system_hash", "input").agg(F.min_by(F.struct(
        "expected_behavior", "failure_type", "system_type", F.col(run_date_col).alias("run_date"),
        "seq"), F.col("seq")).alias("r"))
    if library is not None:
        first = first.join(library.select("system_hash", "input"), ["system_hash", "input"], "left_anti")
    return first.select(
        "system_hash", "input", F.col("r.expected_behavior").alias("expected_behavior"),
        F.lit("HARD").alias("difficulty"),
        F.array(F.lit("regression"), F.concat(F.lit("regression_"), F.substring("system_hash", 1, 8)),
                F.lower("r.failure_type"),
                F.concat(F.lit("run_"), F.date_format("r.run_date", "yyyyMMdd"))).alias("tags"),
        F.col("r.system_type").alias("system_type"), F.col("r.seq").alias("seq"))


def load_regressions(library: DataFrame, system_hashes: DataFrame) -> DataFrame:
    """L-02: regression scenarios of the given systems; rows with an unknown
    system type or difficulty are skipped."""
    lib = library.join(system_hashes.select("system_hash").distinct(), "system_hash", "left_semi")
    return lib.where(F.col("system_type").isin(S.SYSTEM_TYPES)
                     & F.coalesce(F.col("difficulty"), F.lit("HARD")).isin(S.DIFFICULTIES))


def finetuning_pairs(joined: DataFrame) -> DataFrame:
    """L-03: (input, wrong output, correct output) per failed typed result; no dedupe."""
    wrong = F.col("actual_response") if "actual_response" in joined.columns else F.lit(None).cast("string")
    return joined.where(~F.col("passed") & F.col("failure_type").isNotNull()).select(
        "system_hash", "scenario_id", "input", wrong.alias("wrong_output"),
        F.col("expected_behavior").alias("correct_output"), "failure_type", "difficulty", "tags")


def strategy_weights(patterns: DataFrame, runs: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """A-23: per (system, failure type) weight = min(3, w + 0.5 per pattern).

    Because the cap is monotone, applying runs one after another equals one
    aggregate over all of them: min(3, w0 + 0.5 * patterns)."""
    n = patterns.groupBy("system_hash", "failure_type").agg(F.count(F.lit(1)).alias("n_patterns"))
    if state is not None:
        n = n.join(state.select("system_hash", "failure_type", "weight"),
                   ["system_hash", "failure_type"], "full")
        base = F.coalesce(F.col("weight"), F.lit(1.0))
        w = F.when(F.col("n_patterns").isNull(), F.col("weight")).otherwise(
            F.least(F.lit(WEIGHT_CAP), base + WEIGHT_STEP * F.col("n_patterns")))
    else:
        w = F.least(F.lit(WEIGHT_CAP), F.lit(1.0) + WEIGHT_STEP * F.col("n_patterns"))
    weights = n.select("system_hash", "failure_type", w.alias("weight"))
    meta = runs.groupBy("system_hash").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.max_by("pass_rate", F.struct("created_at", "run_id")).alias("last_pass_rate"))
    return weights.join(meta, "system_hash", "left")


def strategy_state(patterns: DataFrame, runs: DataFrame, state: DataFrame | None = None,
                   top: int = FOUND_PATTERNS) -> DataFrame:
    """A-23: the strategy of each system, one row: failure_weights (map),
    last_pass_rate, found_patterns (the ``top`` first of the latest run),
    run_count.  ``state`` is an earlier result of this function; folding runs in
    two steps equals one step over all, as the cap on weights is monotone.

    patterns: (system_hash, run_id, pattern_rank, cluster_label, root_cause,
    failure_type, scenario_count); runs: (system_hash, run_id, created_at, pass_rate).
    Maps are keyed by the closed list of failure types, so they stay small."""
    n = (patterns.groupBy("system_hash", "failure_type").agg(F.count(F.lit(1)).alias("n"))
         .groupBy("system_hash").agg(F.map_from_entries(F.collect_list(F.struct("failure_type", "n"))).alias("n")))
    latest = runs.groupBy("system_hash").agg(
        F.count(F.lit(1)).alias("new_runs"),
        F.max_by(F.struct("run_id", "pass_rate"), F.struct("created_at", "run_id")).alias("r")).select("system_hash", "new_runs", "r.*")
    found = (patterns.where(F.col("pattern_rank") <= top).join(latest.select("system_hash", "run_id"), ["system_hash", "run_id"])
             .groupBy("system_hash").agg(F.transform(
                 F.array_sort(F.collect_list(F.struct("pattern_rank", "cluster_label", "root_cause", "failure_type",
                                                      F.col("scenario_count").cast("long").alias("count")))),
                 lambda p: F.struct(p["cluster_label"].alias("cluster_label"), p["root_cause"].alias("root_cause"),
                                    p["failure_type"].alias("failure_type"), p["count"].alias("count"))).alias("found")))
    new = latest.join(n, "system_hash", "left").join(found, "system_hash", "left")
    none = F.create_map().cast("map<string,double>")
    if state is None:
        old_weights, old_runs = none, F.lit(0)
        new = new.withColumns({"failure_weights": none, "last_pass_rate": F.lit(None).cast("double"),
                               "found_patterns": F.lit(None).cast(found.schema["found"].dataType)})
    else:
        new = new.join(state, "system_hash", "full")
        old_weights, old_runs = F.coalesce("failure_weights", none), F.coalesce("run_count", F.lit(0))
    weights = F.map_zip_with(old_weights, F.coalesce("n", F.create_map().cast("map<string,bigint>")), lambda k, w, c: F.least(
        F.lit(WEIGHT_CAP), F.coalesce(w, F.lit(1.0)) + WEIGHT_STEP * F.coalesce(c, F.lit(0))))
    ran = F.col("new_runs").isNotNull()
    return new.select(
        "system_hash", weights.alias("failure_weights"),
        F.when(ran, F.col("pass_rate")).otherwise(F.col("last_pass_rate")).alias("last_pass_rate"),
        F.when(ran, F.coalesce("found", F.array().cast(found.schema["found"].dataType))).otherwise(F.col("found_patterns")).alias("found_patterns"),
        (old_runs + F.coalesce("new_runs", F.lit(0))).cast("long").alias("run_count"))


def generation_strategy(state: DataFrame, systems: DataFrame) -> DataFrame:
    """L-05: the stored strategy of the given systems; a system without one gets
    an empty strategy (no weights, no patterns, no runs)."""
    wanted = systems.select("system_hash").distinct()
    j = wanted.join(state, "system_hash", "left")
    return j.select("system_hash", F.coalesce("failure_weights", F.create_map().cast("map<string,double>")).alias("failure_weights"),
                    "last_pass_rate", "found_patterns", F.coalesce("run_count", F.lit(0)).alias("run_count"))


def persona_effectiveness(uses: DataFrame, bucket_width: int = 1 << 20, state: DataFrame | None = None) -> DataFrame:
    """A-22 with W-07: sticky persona status per (persona, system_type).

    First use -> active.  From the second use on, the running rate >= 0.40
    sets high_value, rate <= 0.05 with >= 5 uses sets retired, otherwise the
    status stays.  Final status = the transition of the last use where a
    threshold fired (else active).

    The running counts are a distributed prefix sum, so a persona used in a
    third of all events never lands in one task: events are cut into
    ``ord`` buckets, each (persona, system, bucket) slice is ranked locally,
    bucket totals are prefix-summed over the (small) per-bucket table and
    joined back as offsets.  Threshold tests are exact integer comparisons.

    ``state`` (persona, system_type, times_used, failures, status): what earlier
    uses came to; the result holds its personas too.
    """
    from .ranking import ranked
    keys = ["persona", "system_type"]
    base = None if state is None else state.select(*keys, F.col("times_used").alias("rank"), F.col("failures").alias("fails"))
    run = ranked(uses, keys, "ord", bucket_width, sums={"fails": F.col("found_failure").cast("int")}, base=base) \
        .withColumnRenamed("rank", "times")
    t, f = F.col("times"), F.col("fails")
    # exact: f/t >= 0.40  <=>  5f >= 2t ;  f/t <= 0.05  <=>  20f <= t
    trans = (F.when(t == 1, F.lit(None))
              .when(5 * f >= 2 * t, F.lit("high_value"))
              .when((20 * f <= t) & (t >= RETIRE_MIN_USES), F.lit("retired")))
    run = run.withColumn("transition", trans)
    agg = run.groupBy(*keys).agg(
        F.max("times").alias("times_used"), F.max_by("fails", "times").alias("failures"),
        F.max_by("transition", F.when(F.col("transition").isNotNull(), F.col("ord"))).alias("_last"))
    if state is not None:
        old = state.select(*keys, F.col("times_used").alias("_times"), F.col("failures").alias("_fails"), F.col("status").alias("_status"))
        agg = agg.join(old, keys, "full").select(*keys, F.coalesce("times_used", "_times").alias("times_used"),
                                                 F.coalesce("failures", "_fails").alias("failures"), F.coalesce("_last", "_status").alias("_last"))
    return agg.select(*keys, "times_used", "failures",
                      (F.col("failures") / F.col("times_used")).alias("failure_discovery_rate"),
                      F.coalesce("_last", F.lit("active")).alias("status"))


def persona_running_rate(uses: DataFrame, bucket_width: int = 1 << 20) -> DataFrame:
    """W-07: the running discovery rate after each use of a persona (replay),
    from the same distributed running counts as A-22."""
    from .ranking import ranked
    r = ranked(uses, ["persona", "system_type"], "ord", bucket_width,
               sums={"fails": F.col("found_failure").cast("int")})
    return r.select("persona", "system_type", "ord", F.col("rank").alias("times_used"),
                    (F.col("fails") / F.col("rank")).alias("running_rate"))


def failure_context(history_breakdown: DataFrame) -> DataFrame:
    """A-18: failure counts summed over a company's recent runs, ranked
    (count desc, then first appearance: newest run first, then result order)."""
    g = history_breakdown.groupBy("company", "failure_type").agg(
        F.sum("n").cast("bigint").alias("n"), F.min(F.struct("run_rank", "first_seq")).alias("_f"))
    w = Window.partitionBy("company").orderBy(F.desc("n"), "_f")
    return g.withColumn("rank", F.row_number().over(w)).drop("_f")
