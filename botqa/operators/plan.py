"""Scenario planning per system (P-16..P-18, P-21, P-23, P-24, J-03, J-08, J-10, K-03).

Inputs are small per-system tables (one row per system, a persona list per
system); every operator is a projection or an equi-join on the system key.
Positions that Python took from list order are explicit columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .learn import RETIRE_MIN_USES

# FIXED VALUES — planning
RELIABLE_PASS_RATE = 0.85
PRE_DEPLOYMENT_COUNT = 500
DEFAULT_MAX_SCENARIOS = 200
GENERATOR_BATCH = 20
CRITIC_THRESHOLD = 3.5
CRITIC_ATTEMPTS = 3
# (new_edge_cases, from_failures, adversarial) by maturity
MATURITY_RATIOS = {"NEW": (1.0, 0.0, 0.0), "RUNNING": (0.50, 0.30, 0.20), "RELIABLE": (0.20, 0.60, 0.20)}
# persona pool size by available context: (has_description, has_conversations) -> total
PERSONA_TOTALS = {(False, False): 20, (True, False): 30, (False, True): 40, (True, True): 50}


def effective_count(deployment: Column, max_scenarios: Column) -> Column:
    """P-16: PRE_DEPLOYMENT with the default 200 becomes 500, else max_scenarios."""
    return F.when((deployment == "PRE_DEPLOYMENT") & (max_scenarios == DEFAULT_MAX_SCENARIOS),
                  F.lit(PRE_DEPLOYMENT_COUNT)).otherwise(max_scenarios)


def maturity(has_history: Column, latest_pass_rate: Column, configured: Column) -> Column:
    """P-17: NEW without history; otherwise RELIABLE (latest >= 0.85) or RUNNING,
    unless a non-NEW maturity was configured."""
    detected = F.when(latest_pass_rate >= RELIABLE_PASS_RATE, "RELIABLE").otherwise("RUNNING")
    return (F.when(~has_history, F.lit("NEW"))
             .when(F.coalesce(configured, F.lit("NEW")) == "NEW", detected).otherwise(configured))


def scenario_mix(total: Column, mat: Column, strategy: Column, ratios: dict | None = None) -> Column:
    """P-18: struct(new_edge_cases, from_failures, adversarial).  SMART_MIX uses
    the maturity ratios with int() truncation and the remainder adversarial;
    an explicit strategy puts everything in one bucket.  ``ratios`` optionally
    overrides the (new, failures, adversarial) ratios per maturity (T16: the
    configurable weights that the source declares but never reads)."""
    table = {**MATURITY_RATIOS, **(ratios or {})}

    def ratio(i):
        return (F.when(mat == "NEW", table["NEW"][i])
                 .when(mat == "RUNNING", table["RUNNING"][i])
                 .otherwise(table["RELIABLE"][i]))
    new = (total * ratio(0)).cast("int")
    fail = (total * ratio(1)).cast("int")
    adv = F.greatest(F.lit(0), total - new - fail)
    s = F.coalesce(strategy, F.lit("SMART_MIX"))
    zero = F.lit(0)
    return (F.when(s == "FROM_SCRATCH", F.struct(total.alias("new_edge_cases"), zero.alias("from_failures"),
                                                  zero.alias("adversarial")))
             .when(s == "FROM_FAILURES", F.struct(zero.alias("new_edge_cases"), total.alias("from_failures"),
                                                   zero.alias("adversarial")))
             .when(s == "ADVERSARIAL_FROM_CORRECT", F.struct(zero.alias("new_edge_cases"),
                                                              zero.alias("from_failures"),
                                                              total.alias("adversarial")))
             .otherwise(F.struct(new.alias("new_edge_cases"), fail.alias("from_failures"),
                                 adv.alias("adversarial"))))


def failure_focus_fallback(mix: Column, n_triggers: Column, n_known_types: Column) -> Column:
    """P-24: with no failure triggers and no known failure types, the
    from-failures bucket is generated as new edge cases."""
    empty = (F.coalesce(n_triggers, F.lit(0)) == 0) & (F.coalesce(n_known_types, F.lit(0)) == 0)
    return F.when(empty, F.struct((mix["new_edge_cases"] + mix["from_failures"]).alias("new_edge_cases"),
                                  F.lit(0).alias("from_failures"), mix["adversarial"].alias("adversarial"))
                  ).otherwise(mix)


def persona_total(has_description: Column, has_conversations: Column) -> Column:
    """P-23: 20 / 30 / 40 / 50 personas by available context (an upper bound)."""
    return (F.when(has_description & has_conversations, 50).when(has_description, 30)
             .when(has_conversations, 40).otherwise(20))


def rank_personas(personas: DataFrame, systems: DataFrame, key: str = "system",
                  on: str = "system_type") -> DataFrame:
    """J-10: per system, personas relevant to its industry first (case-insensitive
    match against the persona's industries), then the rest, library order kept.
    The persona library of a system is found by an equi-join on ``on``."""
    j = systems.select(key, on, "industry").join(personas, on)
    rel = F.when(F.col("industry").isNull(), F.lit(False)).otherwise(
        F.exists("industries", lambda i: F.lower(i) == F.lower(F.col("industry"))))
    w = Window.partitionBy(key).orderBy(F.desc(rel), "persona_ord")
    return j.withColumn("relevant", rel).withColumn("rank", F.row_number().over(w))


def persona_status(personas: DataFrame, effectiveness: DataFrame, keys=("persona", "system_type")) -> DataFrame:
    """J-03: library status updated from learned effectiveness: rate >= 0.40
    -> high_value; rate <= 0.05 with >= 5 uses -> retired; else unchanged."""
    e = effectiveness.select(*keys, "times_used", "failures")
    j = personas.join(e, list(keys), "left")
    f, t = F.col("failures"), F.col("times_used")
    st = (F.when(t.isNull(), F.col("status"))
           # exact integer forms of f/t >= 0.40 and f/t <= 0.05
           .when(5 * f >= 2 * t, F.lit("high_value"))
           .when((20 * f <= t) & (t >= RETIRE_MIN_USES), F.lit("retired"))
           .otherwise(F.col("status")))
    return j.withColumn("status", st)


def weighted_persona_slots(personas: DataFrame, slots: DataFrame, key: str = "system") -> DataFrame:
    """J-08: the persona of every scenario slot.  Weighted list per system =
    high_value personas three times (in order), then active ones; slot s of a
    batch of 20 takes entry ``s % len``.  With nobody active, slot s takes the
    s-th persona of the library order.

    personas: (key, persona, persona_ord, status); slots: (key, seq) with seq 0-based.
    Equi-join on (key, index) — the weighted list is at most 3 x 50 rows per system."""
    hv = personas.where(F.col("status") == "high_value")
    act = personas.where(F.col("status") == "active")
    whv = Window.partitionBy(key).orderBy("persona_ord")
    hv = hv.withColumn("_j", F.row_number().over(whv) - 1)
    k_hv = hv.groupBy(key).agg(F.count(F.lit(1)).alias("_k"))
    act = act.withColumn("_j", F.row_number().over(whv) - 1)
    hv_rows = (hv.join(k_hv, key).select(key, "persona", "_j", "_k",
                                         F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("_c"))
                 .select(key, "persona", (F.col("_c") * F.col("_k") + F.col("_j")).alias("widx")))
    act_rows = (act.join(k_hv, key, "left")
                   .select(key, "persona", (3 * F.coalesce(F.col("_k"), F.lit(0)) + F.col("_j")).alias("widx")))
    weighted = hv_rows.unionByName(act_rows)
    sizes = weighted.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    s = slots.join(sizes, key, "left").withColumn("_slot", F.col("seq") % GENERATOR_BATCH)
    with_w = (s.where(F.col("_n").isNotNull())
               .withColumn("widx", F.pmod(F.col("_slot"), F.col("_n")))
               .join(weighted, [key, "widx"]).select(key, "seq", "persona"))
    lib = personas.select(key, "persona", (F.row_number().over(whv) - 1).alias("_slot"))
    fallback = (s.where(F.col("_n").isNull()).join(lib, [key, "_slot"])
                 .select(key, "seq", "persona"))
    return with_w.unionByName(fallback)


def cut_to_count(scenarios: DataFrame, count: Column, key: str = "run_id", order_col: str = "seq",
                 bucket_width: int = 1 << 20) -> DataFrame:
    """K-03: keep the first ``count`` scenarios of each run (P-16's effective
    count, an expression on the row: no join on a hot run).  The ranking is
    distributed, so no run is numbered in a single task."""
    from .ranking import ranked
    return ranked(scenarios, [key], order_col, bucket_width).where(F.col("rank") <= count).drop("rank")


def critic_gate(candidates: DataFrame, scores: DataFrame, key: str = "batch_id") -> DataFrame:
    """P-21: candidates (batch_id, slot); scores (batch_id, attempt, slot, average).

    Attempt a scores the slots still pending.  If the number of scores for a
    batch's attempt differs from the number of pending slots, the whole
    attempt is approved (the reply did not line up).  A slot is approved at
    its first attempt with average >= 3.5; after the last attempt the rest is
    accepted as ``below_threshold``.

    One shuffle: a batch (at most 20 slots) is gathered with its scores into
    arrays, and the attempts are unrolled as array expressions on that row."""
    attempts = range(1, CRITIC_ATTEMPTS + 1)
    rows = candidates.select(key, F.lit(0).alias("attempt"), "slot", F.lit(None).cast("double").alias("average")).unionByName(
        scores.select(key, F.col("attempt").cast("int").alias("attempt"), "slot", F.col("average").cast("double").alias("average")))
    batch = rows.groupBy(key).agg(
        F.collect_list(F.when(F.col("attempt") == 0, F.col("slot"))).alias("_pending"),
        *[F.collect_list(F.when(F.col("attempt") == a, F.struct("slot", "average"))).alias(f"_s{a}") for a in attempts])

    def attempt(batch: DataFrame, a: int) -> DataFrame:
        last = F.lit(a == CRITIC_ATTEMPTS)
        missing = F.array(F.struct(F.lit(None).alias("slot"), F.lit(None).cast("double").alias("average")))
        unaligned = F.size(f"_s{a}") != F.size("_pending")

        def scored(slot: Column) -> Column:
            found = F.filter(f"_s{a}", lambda s: s["slot"] == slot)
            return F.transform(F.when(F.size(found) > 0, found).otherwise(missing), lambda s: F.struct(
                slot.alias("slot"), (unaligned | (F.coalesce(s["average"], F.lit(0.0)) >= CRITIC_THRESHOLD)).alias("ok")))

        batch = batch.withColumn("_step", F.flatten(F.transform("_pending", scored)))
        decided = F.transform(F.filter("_step", lambda s: s["ok"] | last), lambda s: F.struct(
            s["slot"].alias("slot"), F.lit(a).alias("attempt"),
            F.when(s["ok"], F.lit("approved")).otherwise(F.lit("below_threshold")).alias("outcome")))
        return batch.withColumn(f"_d{a}", decided).withColumn(
            "_pending", F.transform(F.filter("_step", lambda s: ~s["ok"]), lambda s: s["slot"]))

    for a in attempts:
        batch = attempt(batch, a)
    return batch.select(key, F.inline(F.concat(*[F.col(f"_d{a}") for a in attempts])))


def persona_pools(personas: DataFrame, key: str = "system") -> DataFrame:
    """P-08: retired personas dropped; high-value and active personas kept apart
    (per system: counts and the weighted-list length 3 x high_value + active)."""
    live = personas.where(F.col("status") != "retired")
    return live.groupBy(key).agg(
        F.count_if(F.col("status") == "high_value").alias("high_value"),
        F.count_if(F.col("status") == "active").alias("active"),
        (3 * F.count_if(F.col("status") == "high_value") + F.count_if(F.col("status") == "active"))
        .alias("weighted_len"))
