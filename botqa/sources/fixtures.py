"""Entity tables derived from the input tables (FIXTURES.md §2).

Each function maps the driver's generic tables onto one entity of the data
model (conversations with outcomes, bot replies, judge verdicts, results,
runs, ...).  Every row of the source feeds the fixture; the modulo
expressions only *assign* attributes (company, slot, status), they never
select a subset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runlog import RUN_EVENT_SCHEMA
from .tables import Tables


def _company(key: Column) -> Column:
    return F.concat(F.lit("co_"), (key % 7).cast("string"))


def _system_type(key: Column) -> Column:
    return (F.when(key % 3 == 0, "CUSTOMER_SUPPORT")
             .when(key % 3 == 1, "RAG").otherwise("MULTI_AGENT"))


def conv(t: Tables) -> DataFrame:
    """Conversation messages with outcome and company (input of P-06, A-09..A-17)."""
    c = t.conversations
    return c.select(
        "conv_id", "turn", "role", F.col("text").alias("content"),
        F.when(c.conv_id % 3 == 0, "good: resolved")
         .when(c.conv_id % 3 == 1, "bad answer").alias("outcome"),
        _company(c.conv_id).alias("company"),
    )


def responses(t: Tables) -> DataFrame:
    """User turn + the assistant turn that follows it (input of P-02..P-05)."""
    c = t.conversations
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = c.select(
        "conv_id", "turn", "role", "text",
        F.lead("role").over(w).alias("next_role"),
        F.lead("text").over(w).alias("actual_response"),
    )
    return (nxt.where((F.col("role") == "user")
                      & (F.col("next_role").eqNullSafe("assistant") | F.col("next_role").isNull()))
            .select((F.col("conv_id") * 1000000 + F.col("turn")).alias("scenario_id"),
                    _company(F.col("conv_id")).alias("company"),
                    F.col("text").alias("input"),
                    "actual_response",
                    (F.lit(100) + (F.col("conv_id") * 37 + F.col("turn") * 11) % 900)
                    .cast("double").alias("latency_ms")))


def verdicts(t: Tables) -> DataFrame:
    """One judge verdict per event; ``error`` events are judges that returned nothing."""
    e = t.events
    return (e.where(F.col("event_type") != "error")
             .select(F.floor(e.event_id / 3).cast("bigint").alias("scenario_id"),
                     (e.event_id % 3).cast("int").alias("slot"),
                     F.concat(F.lit("judge_"), (e.event_id % 3).cast("string")).alias("judge_model"),
                     e.event_type.isin("view", "click").alias("passed"),
                     F.when(e.event_type == "signup", "WRONG_ANSWER")
                      .when(e.event_type == "purchase", "POLICY_VIOLATION").alias("failure_type"),
                     (e.value / F.lit(500.0)).alias("confidence"),
                     e.ts.alias("created_at")))


def panel_scenarios(t: Tables) -> DataFrame:
    """Every scenario that was sent to the panel, with or without verdicts."""
    return (t.events.select(F.floor(F.col("event_id") / 3).cast("bigint").alias("scenario_id"))
            .distinct())


def raw_replies(t: Tables) -> DataFrame:
    """Raw judge reply text in five shapes (plain, fenced, bare, prose, bad type)."""
    e = t.events.select("event_id", F.when(F.col("value") < 250, "true").otherwise("false").alias("body"))
    nl = F.lit("\n")
    m = F.col("event_id") % 5
    raw = (F.when(m == 0, F.concat(F.lit('{"passed": '), "body", F.lit(', "confidence": 0.5, "reasoning": "ok"}')))
            .when(m == 1, F.concat(F.lit("```json"), nl, F.lit('{"passed": '), "body",
                                   F.lit(', "failure_type": "INCOMPLETE", "confidence": 0.25}'), nl, F.lit("```")))
            .when(m == 2, F.concat(F.lit('{"passed": '), "body", F.lit("}")))
            .when(m == 3, F.lit("I cannot answer in JSON"))
            .otherwise(F.concat(F.lit("```"), nl, F.lit('{"passed": '), "body",
                                F.lit(', "failure_type": "NOT_A_TYPE"}'), nl, F.lit("```"))))
    return e.select(F.col("event_id").alias("reply_id"), raw.alias("raw"))


def scenarios(t: Tables) -> DataFrame:
    o = t.orders
    k = o.o_orderkey
    return o.select(
        k.alias("scenario_id"),
        _company(o.o_custkey).alias("company"),
        _system_type(k).alias("system_type"),
        F.concat(F.lit("input "), (k % 500).cast("string")).alias("input"),
        F.concat(F.lit("expected "), (k % 500).cast("string")).alias("expected_behavior"),
        F.when(k % 4 == 0, "EASY").when(k % 4 == 1, "MEDIUM").when(k % 4 == 2, "HARD")
         .otherwise("ADVERSARIAL").alias("difficulty"),
        F.when(k % 5 == 0, F.lit(""))
         .otherwise(F.concat(F.lit("tag_"), (k % 3).cast("string"), F.lit("|pri_"),
                             F.substring(o.o_orderpriority, 1, 1))).alias("tag_list"),
        o.o_orderdate.alias("created_at"),
    )


def _passed_expr(o: DataFrame) -> Column:
    return (o.o_orderstatus != "P") | ((o.o_orderkey % 7) < (o.o_custkey % 7))


def results(t: Tables) -> DataFrame:
    o = t.orders
    passed = _passed_expr(o)
    company = _company(o.o_custkey)
    return o.select(
        o.o_orderkey.alias("result_id"),
        o.o_orderkey.alias("scenario_id"),
        company.alias("company"),
        F.concat(company, F.lit("_"), F.year(o.o_orderdate).cast("string"), F.lit("q"),
                 F.quarter(o.o_orderdate).cast("string")).alias("run_id"),
        passed.alias("passed"),
        F.when(passed, F.lit(None).cast("string"))
         .when(o.o_orderpriority == "1-URGENT", "POLICY_VIOLATION")
         .when(o.o_orderpriority == "2-HIGH", "HALLUCINATION")
         .when(o.o_orderpriority == "3-MEDIUM", "WRONG_ANSWER")
         .when(o.o_orderpriority == "4-NOT SPECIFIED", "ESCALATION_FAILURE").alias("failure_type"),
        F.when(o.o_orderkey % 4 == 0, 0.95).when(o.o_orderkey % 4 == 1, 0.33)
         .otherwise(0.75).cast("double").alias("confidence_score"),
        (o.o_totalprice / F.lit(100.0)).alias("latency_ms"),
        F.floor(o.o_totalprice / 100).cast("bigint").alias("tokens"),
        o.o_orderdate.alias("created_at"),
    )


def runs(t: Tables) -> DataFrame:
    """Run log rows derived from results (one per run)."""
    r = results(t)
    first = F.min("result_id")
    return (r.groupBy("run_id", "company")
             .agg(F.min("created_at").alias("created_at"),
                  F.when(first % 11 == 0, "failed").when(first % 13 == 0, "running")
                   .otherwise("completed").alias("status"),
                  F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)).alias("pass_rate"),
                  F.count(F.lit(1)).alias("total_scenarios"),
                  F.sum(F.when(F.col("passed"), 0).otherwise(1)).cast("bigint").alias("total_failures"),
                  F.round(F.sum("tokens").cast("double") / 1000 * F.lit(0.003), 4).alias("run_cost_usd")))


def persona_use(t: Tables) -> DataFrame:
    e = t.events
    return e.select(
        e.event_id.alias("ord"),
        F.concat(F.lit("p_"), (e.user_id % 20).cast("string")).alias("persona"),
        _system_type(e.event_id).alias("system_type"),
        (((e.event_id * 7) % 100) < ((e.user_id % 20) * 4)).alias("found_failure"),
    )


def human_labels(t: Tables) -> DataFrame:
    lab = t.labels.alias("l")
    docs = t.documents.select("doc_id", "source")
    j = lab.join(docs, "doc_id")
    return j.select(
        F.col("doc_id").alias("result_id"), F.col("source").alias("domain"),
        (F.col("quality") == 1).alias("human_passed"),
        F.when(F.col("doc_id") % 5 == 0, F.col("quality") == 0)
         .otherwise(F.col("quality") == 1).alias("judge_passed"),
    )


def kb_docs(t: Tables) -> DataFrame:
    d = t.documents
    m = d.doc_id % 4
    return d.select(
        d.doc_id.cast("string").alias("doc_id"), d.text.alias("content"), "source",
        F.when(m == 0, "UPLOADED").when(m == 1, "SCRAPED_COMPANY_SITE")
         .when(m == 2, "SCRAPED_EXTERNAL").otherwise("SYNTHETIC_CHALLENGING").alias("source_type"),
        (m == 3).alias("is_synthetic"),
    )


def fail_vecs(t: Tables) -> DataFrame:
    e = t.embeddings
    return e.select(e.vec_id.alias("result_id"),
                    F.concat(F.lit("r_"), (e.vec_id % 5).cast("string")).alias("run_id"),
                    "embedding", "label")


def _run_system_type(company: Column) -> Column:
    k = F.substring(company, 4, 8).cast("int") % 3
    return F.when(k == 0, "CUSTOMER_SUPPORT").when(k == 1, "RAG").otherwise("MULTI_AGENT")


def run_events(t: Tables) -> DataFrame:
    """Run log events derived from ``runs``: an insert (running, with the request), a
    completion update with totals and the result, analysis and fix payloads as they
    are stored, and a delete tombstone for runs whose scenario count is a multiple
    of 10.  Every seventh request is cut off, so it is not JSON."""
    r, res = runs(t), results(t)
    listed = res.groupBy("run_id").agg(F.collect_list(F.struct("scenario_id", "passed", "failure_type", "confidence_score")).alias("results"))
    found = (res.where(~F.col("passed") & F.col("failure_type").isNotNull()).groupBy("run_id", "failure_type").agg(F.count(F.lit(1)).alias("count"))
             .groupBy("run_id").agg(F.collect_list(F.struct("failure_type", "count")).alias("patterns")))
    r = r.join(listed, "run_id", "left").join(found, "run_id", "left")
    none = F.array().cast("array<struct<failure_type: string, count: bigint>>")
    patterns, keep = F.coalesce("patterns", none), {"ignoreNullFields": "false"}
    request = F.to_json(F.struct(F.col("company").alias("company_name"), _run_system_type(F.col("company")).alias("system_type"),
                                 F.lit("target-model").alias("target_model"), F.col("total_scenarios").cast("bigint").alias("scenario_count")), keep)
    request = F.when(F.col("total_scenarios") % 7 == 3, F.substring(request, 1, 20)).otherwise(request)
    result = F.to_json(F.struct(F.col("pass_rate").alias("pass_rate"), F.col("total_scenarios").cast("bigint").alias("total_scenarios"),
                                (F.col("total_scenarios") - F.col("total_failures")).cast("bigint").alias("passed"),
                                F.col("total_failures").cast("bigint").alias("failed"), F.col("results").alias("results")), keep)
    analysis = F.to_json(F.struct(F.col("total_failures").cast("bigint").alias("total_failures"), patterns.alias("patterns")), keep)
    fixes = F.to_json(F.struct(F.size(patterns).cast("bigint").alias("total_fixes"), F.transform(patterns, lambda p: F.struct(
        p["failure_type"].alias("failure_type"), F.lit("PROMPT_ADDITION").alias("fix_type"), p["count"].alias("affected_scenarios"))).alias("fixes")), keep)
    columns = RUN_EVENT_SCHEMA.fields

    def events(rows: DataFrame, hours: int, seq: int, op: str, **given) -> DataFrame:
        given |= {"event_ts": F.col("created_at") + F.expr(f"INTERVAL {hours} HOUR"), "seq": F.lit(seq), "op": F.lit(op), "run_id": F.col("run_id")}
        return rows.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in columns])

    ins = events(r, 0, 1, "upsert", created_at=F.col("created_at"), company_name=F.col("company"), system_type=_run_system_type(F.col("company")),
                 target_model=F.lit("target-model"), status=F.lit("running"), config_json=request)
    done = events(r, 1, 2, "upsert", status=F.when(F.col("status") != "running", F.col("status")), results_json=result, analysis_json=analysis,
                  fixes_json=fixes, error_message=F.when(F.col("status") == "failed", F.lit("Pipeline error")),
                  **{c: F.col(c) for c in ("pass_rate", "total_scenarios", "total_failures", "run_cost_usd")})
    return ins.unionByName(done).unionByName(events(r.where(F.col("total_scenarios") % 10 == 0), 2, 3, "delete"))
