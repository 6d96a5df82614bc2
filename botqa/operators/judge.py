"""Judging chain: request bodies, rule checks, panel verdicts, result rows,
batches and budget (P-01..P-05, P-35, A-03, J-05, J-06, W-01, W-02).

Everything is keyed by ``scenario_id`` (or ``run_id``); a panel has at most a
handful of verdicts per scenario so every aggregate here is a hash aggregate
with map-side partial combine and one shuffle on the scenario key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.replies import parse_judge_reply
from ..functions.text import contains_any, py_strip


# ---------------------------------------------------------------------------
# P-01 request body, P-02 reply extraction
# ---------------------------------------------------------------------------
def request_body(df: DataFrame, input_col: str = "input", message_field: str = "message",
                 extra_fields: Column | None = None) -> DataFrame:
    """P-01: JSON body ``{message_field: input}`` then ``extra_fields`` (a
    map<string,string> column); an extra field with the same key wins."""
    base = F.create_map(F.lit(message_field), F.col(input_col))
    if extra_fields is None:
        body = base
    else:
        # drop clashing keys first: correct whatever spark.sql.mapKeyDedupPolicy says
        kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(extra_fields), k))
        body = F.map_concat(kept, extra_fields)
    return df.withColumn("request_body", F.to_json(body))


# ---------------------------------------------------------------------------
# P-03 rule checks, P-04/P-05 result assembly
# ---------------------------------------------------------------------------
def rule_failure(reply: Column, user_input: Column, *, system_type: Column | None = None,
                 prohibited: Column | None = None,
                 refusal_phrases: Sequence[str] = tuple(S.REFUSAL_PHRASES)) -> Column:
    """P-03: first failing rule or null.

    a) stripped reply shorter than 5 chars -> INCOMPLETE
    b) a refusal phrase in the lower-cased reply and no ``?`` in the input -> INCOMPLETE
    c) customer support only: a prohibited action (``_`` -> space, lower) in the reply -> POLICY_VIOLATION
    """
    low = F.lower(py_strip(reply))
    short = reply.isNull() | (F.length(py_strip(reply)) < S.MIN_REPLY_CHARS)
    refusal = contains_any(low, refusal_phrases) & ~F.contains(user_input, F.lit("?"))
    out = F.when(short, F.lit("INCOMPLETE")).when(refusal, F.lit("INCOMPLETE"))
    if prohibited is not None:
        norm = F.transform(prohibited, lambda a: F.replace(F.lower(a), F.lit("_"), F.lit(" ")))
        hit = F.exists(norm, lambda a: F.contains(low, a))
        if system_type is not None:
            hit = (system_type == "CUSTOMER_SUPPORT") & hit
        out = out.when(F.coalesce(hit, F.lit(False)), F.lit("POLICY_VIOLATION"))
    return out


def apply_rules(responses: DataFrame, *, prohibited_actions: Sequence[str] | None = None,
                refusal_phrases: Sequence[str] = tuple(S.REFUSAL_PHRASES),
                system_type: str | None = "CUSTOMER_SUPPORT") -> DataFrame:
    """Adds ``rule_failure`` to a (scenario_id, input, actual_response) table."""
    prohibited = (F.array(*[F.lit(p) for p in prohibited_actions]).cast("array<string>")
                  if prohibited_actions else None)
    st = F.col("system_type") if "system_type" in responses.columns else (
        F.lit(system_type) if system_type else None)
    return responses.withColumn(
        "rule_failure",
        F.when(F.col("actual_response").isNotNull(),
               rule_failure(F.col("actual_response"), F.col("input"), system_type=st,
                            prohibited=prohibited, refusal_phrases=refusal_phrases)))


def assemble_results(responses: DataFrame, panel: DataFrame | None = None) -> DataFrame:
    """P-04/P-05: one result per scenario, precedence error > rule > panel.

    ``responses`` carries ``rule_failure`` (see :func:`apply_rules`); ``panel``
    is the output of :func:`panel_verdict` (only needed for rows that pass the
    rules — join it after filtering, so judges are never asked about rule hits).
    """
    r = responses
    if panel is not None:
        r = r.join(panel.select("scenario_id", F.col("passed").alias("p_passed"),
                                F.col("failure_type").alias("p_failure_type"),
                                F.col("confidence").alias("p_confidence")),
                   "scenario_id", "left")
    else:
        r = (r.withColumn("p_passed", F.lit(None).cast("boolean"))
              .withColumn("p_failure_type", F.lit(None).cast("string"))
              .withColumn("p_confidence", F.lit(None).cast("double")))
    no_reply = F.col("actual_response").isNull()
    rule = F.col("rule_failure")
    return r.select(
        "scenario_id", *[c for c in ("company", "run_id", "system_type", "input") if c in r.columns],
        # a scenario without any panel row is the zero-verdict panel: pass, confidence 0.0
        F.when(no_reply | rule.isNotNull(), F.lit(False))
         .otherwise(F.coalesce(F.col("p_passed"), F.lit(True))).alias("passed"),
        F.when(no_reply, F.lit("INCOMPLETE")).when(rule.isNotNull(), rule)
         .otherwise(F.col("p_failure_type")).alias("failure_type"),
        F.when(no_reply | rule.isNotNull(), F.lit(S.RULE_CONFIDENCE))
         .otherwise(F.coalesce(F.col("p_confidence"), F.lit(0.0))).alias("confidence_score"),
        F.when(no_reply, F.lit("ERROR: Target AI returned no response"))
         .otherwise(F.col("actual_response")).alias("actual_response"),
        *[c for c in ("latency_ms",) if c in r.columns],
        F.when(no_reply | rule.isNotNull(), F.lit("RULE_BASED"))
         .otherwise(F.lit("HYBRID")).alias("evaluation_method"),
    )


# ---------------------------------------------------------------------------
# S-07 judge replies -> verdict rows
# ---------------------------------------------------------------------------
def parse_verdicts(replies: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Adds the parsed columns; invalid replies keep ``valid = false`` and null fields."""
    p = parse_judge_reply(F.col(raw_col))
    return replies.withColumn("_v", p).select(
        *[c for c in replies.columns], F.col("_v.valid").alias("valid"),
        F.col("_v.passed").alias("passed"), F.col("_v.failure_type").alias("failure_type"),
        F.col("_v.confidence").alias("confidence"), F.col("_v.reasoning").alias("reasoning"))


# ---------------------------------------------------------------------------
# A-03 panel verdict
# ---------------------------------------------------------------------------
def panel_verdict(verdicts: DataFrame, scenarios: DataFrame | None = None,
                  failure_types: Sequence[str] = tuple(S.FAILURE_TYPES),
                  keys: Sequence = ("scenario_id",)) -> DataFrame:
    """A-03: majority vote of the judges of each scenario.

    verdicts: (scenario_id, slot, passed, failure_type) — one row per judge
    that answered.  scenarios: every scenario sent to the panel (to produce
    the "no judges" verdict); optional.

    Dominant failure type among failing judges = most votes, ties to the type
    seen first (lowest slot).  Failure types are a closed enum, so the vote
    count per type is a conditional aggregate inside the *same* hash
    aggregate — one shuffle on scenario_id, no second grouping level.
    """
    key_cols = [k if isinstance(k, str) else k for k in keys]
    v = verdicts.select(*[c for c in verdicts.columns if c not in ("slot", "passed", "failure_type")],
                        "slot", "passed",
                        F.when(F.col("failure_type").isin(list(failure_types)),
                               F.col("failure_type")).alias("failure_type"))
    failing = ~F.col("passed")
    aggs = [F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("passed")).alias("pass_votes")]
    cand = []
    for i, t in enumerate(failure_types):
        hit = failing & (F.col("failure_type") == t)
        aggs.append(F.count_if(hit).alias(f"_n{i}"))
        aggs.append(F.min(F.when(hit, F.col("slot"))).alias(f"_s{i}"))
        cand.append(F.struct(F.col(f"_n{i}").alias("n"), (-F.col(f"_s{i}")).alias("neg_slot"),
                             F.lit(t).alias("t")))
    g = v.groupBy(*key_cols).agg(*aggs)
    out_keys = [c for c in g.columns if c not in {a for a in ("total", "pass_votes")} and not c.startswith("_")]
    best = F.array_max(F.filter(F.array(*cand), lambda s: s["n"] > 0))
    g = g.select(*out_keys, "total", "pass_votes",
                 (F.col("total") - F.col("pass_votes")).alias("fail_votes"),
                 best["t"].alias("_top_type"))
    if scenarios is not None:
        g = scenarios.select("scenario_id").join(g, "scenario_id", "left")
    total = F.coalesce(F.col("total"), F.lit(0))
    p = F.coalesce(F.col("pass_votes"), F.lit(0))
    f = F.coalesce(F.col("fail_votes"), F.lit(0))
    maj = F.greatest(p, f)
    none = total == 0
    tie = p == f
    passed = F.when(none, True).when(tie, False).otherwise(p > f)
    level = (F.when(none, "no_judges").when(tie, "tie").when(maj == total, "unanimous")
              .when(maj == total - 1, "majority").otherwise("minority"))
    conf = (F.when(none, 0.0).when(tie, S.PANEL_WEAK_CONFIDENCE)
             .when(maj == total, S.PANEL_UNANIMOUS_CONFIDENCE)
             .when(maj == total - 1, S.PANEL_MAJORITY_CONFIDENCE)
             .otherwise(S.PANEL_WEAK_CONFIDENCE))
    review = none | tie | ((maj != total) & (maj != total - 1))
    reason = (F.when(none, "No judges returned verdicts")
               .when(tie, "Judges tied — equal pass and fail votes")
               .when(review, "Only minority agreement among judges").otherwise(""))
    ftype = F.when(~none & ~tie & (f > p), F.col("_top_type"))
    return g.select(*out_keys,
                    passed.alias("passed"), conf.cast("double").alias("confidence"),
                    level.alias("agreement_level"), review.alias("requires_human_review"),
                    reason.alias("human_review_reason"), ftype.alias("failure_type"),
                    p.cast("bigint").alias("pass_votes"), f.cast("bigint").alias("fail_votes"))


def human_review_queue(panel: DataFrame) -> DataFrame:
    """P-35: results whose panel asks for a human (tie, no verdicts, minority)."""
    return panel.where(F.col("requires_human_review"))


# ---------------------------------------------------------------------------
# W-02 batches, W-01 budget cut-off
# ---------------------------------------------------------------------------
def assign_batches(scenarios: DataFrame, run_col: str = "run_id", order_col: str = "seq",
                   batch_size: int = S.BATCH_SIZE, bucket_width: int = 1 << 20) -> DataFrame:
    """W-02: batch id = position within the run // batch_size.  Positions come
    from the bucketed prefix-sum ranking, so a huge run is numbered by many
    tasks (``order_col`` must be numeric and unique within the run)."""
    from .ranking import ranked
    r = ranked(scenarios, [run_col], order_col, bucket_width)
    return r.withColumn("batch_id", F.floor((F.col("rank") - 1) / batch_size).cast("bigint")).drop("rank")


def budget_cutoff(batch_costs: DataFrame, budgets: DataFrame | None = None,
                  run_col: str = "run_id", cost_col: str = "batch_cost",
                  budget_col: str = "budget_usd") -> DataFrame:
    """W-01: keep the batches that start while the money spent so far is below
    the budget (null or 0 budget = no limit).

    Input is one row per (run, batch) — already aggregated, so the window
    partition per run holds #batches rows (scenarios / 20), not scenarios.
    """
    b = batch_costs
    if budgets is not None:
        b = b.join(budgets, run_col, "left")
    w = (Window.partitionBy(run_col).orderBy("batch_id")
         .rowsBetween(Window.unboundedPreceding, -1))
    spent = F.coalesce(F.sum(cost_col).over(w), F.lit(0.0))
    limit = F.col(budget_col)
    keep = limit.isNull() | (limit == 0) | (spent < limit)
    return b.withColumn("spent_before", spent).withColumn("kept", keep)


# ---------------------------------------------------------------------------
# J-05 eligibility, J-06 panel assignment
# ---------------------------------------------------------------------------
def judge_pool_array(pool=tuple(S.JUDGE_POOL)) -> Column:
    """The configured judge pool as a literal array<struct> (3 entries)."""
    return F.array(*[F.struct(F.lit(m).alias("model"), F.lit(f).alias("family"), F.lit(t).alias("tier"),
                              F.lit(S.TIER_ORDER.get(t, 99)).alias("tier_order")) for m, f, t in pool])


def eligible_judges(targets: DataFrame, pool=tuple(S.JUDGE_POOL), *, strict: bool = True) -> DataFrame:
    """J-05: (target, judge) pairs where the judge may sit on the target's panel.

    targets: (target_id, target_family, target_tier, excluded array<string>).
    The pool is a handful of configured judges carried as a literal array on
    every target row and exploded — no join (not even a broadcast one)."""
    t_order = F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(x) for kv in S.TIER_ORDER.items() for x in kv]),
        F.col("target_tier")), F.lit(2))
    ex = targets.select("*", F.explode(judge_pool_array(pool)).alias("_j")).select(
        *targets.columns, "_j.model", "_j.family", "_j.tier", "_j.tier_order")
    fam_ok = (F.col("family") == "specialized") | (F.col("family") != F.col("target_family"))
    cond = fam_ok & ~F.coalesce(F.array_contains(F.col("excluded"), F.col("model")), F.lit(False))
    if strict:
        cond = cond & (F.col("tier_order") <= t_order)
    return ex.where(cond)


def assign_panels(targets: DataFrame, pool=tuple(S.JUDGE_POOL), seed: int = 0, slots: int = 3) -> DataFrame:
    """J-06: slot 1 = the fixed specialised judge; slots 2..n = seeded random
    choice among eligible judges (tier rule relaxed only when no strict
    candidate is left).  The random choice is a hash of (seed, target, model),
    so it is repeatable; candidates per target are at most the pool size."""
    first = targets.select("target_id", F.lit(1).alias("slot"), F.lit(S.FIXED_FIRST_JUDGE).alias("model"))
    t2 = targets.withColumn("excluded", F.array(F.lit(S.FIXED_FIRST_JUDGE)))
    strict = eligible_judges(t2, pool, strict=True).withColumn("relaxed", F.lit(1))
    loose = eligible_judges(t2, pool, strict=False).withColumn("relaxed", F.lit(2))
    cand = strict.unionByName(loose).groupBy("target_id", "model").agg(F.min("relaxed").alias("relaxed"))
    # strict candidates first (random order among them), relaxed ones after
    w = Window.partitionBy("target_id").orderBy(
        "relaxed", F.xxhash64(F.lit(seed), "target_id", "model"), "model")
    rest = (cand.withColumn("slot", (F.row_number().over(w) + 1).cast("int"))
                .where(F.col("slot") <= slots).select("target_id", "slot", "model"))
    return first.unionByName(rest)
