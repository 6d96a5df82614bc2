"""Registered queries: run store and history (SRC-01, SRC-03..SRC-07, W-03, W-04, W-06, A-18)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import analyze as AN
from ..operators import learn as L
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as FX
from ..sources import runlog as RL
from ..sources import runstore as RS
from .registry import register

# the current-state view of the run log, as SQL over the runs fixture
_LIVE = """
WITH live AS (
  SELECT run_id, created_at, company AS company_name,
         CASE CAST(substr(company, 4) AS INT) % 3 WHEN 0 THEN 'CUSTOMER_SUPPORT' WHEN 1 THEN 'RAG' ELSE 'MULTI_AGENT' END AS system_type,
         'target-model' AS target_model, status, pass_rate, total_scenarios, total_failures, run_cost_usd,
         CASE WHEN status = 'failed' THEN 'Pipeline error' END AS error_message
  FROM runs WHERE total_scenarios % 10 <> 0)
"""


def _live(t):
    return RL.current_runs(FX.run_events(t))


_SUMMARY = ["run_id", "created_at", "company_name", "system_type", "target_model", "status",
            "pass_rate", "total_scenarios", "total_failures", "run_cost_usd", "error_message"]


@register("SRC03_current_runs", _LIVE + "SELECT * FROM live")
def src03_current_runs(t):
    """SRC-03/SRC-04: state of every run from the event log (latest non-null
    value per column), deleted runs removed."""
    return _live(t).select(*_SUMMARY)


@register("SRC01_run_store", _LIVE + "SELECT * FROM live")
def src01_run_store(t):
    """SRC-01: the run log in files; requests and results are folded into the
    snapshot one after the other, deletes are read from the append after it."""
    events, path = FX.run_events(t), f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    for number in range(3):
        RS.append_run_events(events.where(F.col("seq") == number + 1), path, number)
        if number < 2:
            RS.fold_run_events(t.spark, path)
    return RS.read_runs(t.spark, path).select(*_SUMMARY)


@register("SRC04_live_runs_per_company", _LIVE + """
SELECT company_name, COUNT(*) AS live_runs FROM live GROUP BY company_name
""")
def src04_live_runs(t):
    """SRC-04: runs left per company after tombstones."""
    return _live(t).groupBy("company_name").agg(F.count(F.lit(1)).alias("live_runs"))


@register("SRC05_decode_payloads", _LIVE + """,
typed AS (SELECT run_id, failure_type, COUNT(*) AS n FROM results WHERE NOT passed AND failure_type IS NOT NULL GROUP BY ALL),
found AS (SELECT run_id, COUNT(*) AS kinds, SUM(n) AS typed FROM typed GROUP BY run_id)
SELECT live.run_id, total_scenarios % 7 = 3 AS config_undecodable, results_undecodable, analysis_undecodable, fixes_undecodable,
       CASE WHEN total_scenarios % 7 <> 3 THEN company_name END AS config_company,
       CASE WHEN total_scenarios % 7 <> 3 THEN total_scenarios END AS config_scenarios,
       total_scenarios AS payload_total, total_scenarios - total_failures AS payload_passed, total_failures AS payload_failed,
       pass_rate AS payload_pass_rate, total_scenarios AS n_results, COALESCE(kinds, 0) AS n_patterns,
       CAST(COALESCE(typed, 0) AS BIGINT) AS pattern_failures, COALESCE(kinds, 0) AS n_fixes, CAST(COALESCE(typed, 0) AS BIGINT) AS fix_scenarios
FROM live LEFT JOIN found ON found.run_id = live.run_id,
     (SELECT FALSE AS results_undecodable, FALSE AS analysis_undecodable, FALSE AS fixes_undecodable) f
""")
def src05_decode(t):
    """SRC-05: the four payloads of every run, each in its own shape."""
    d = RL.decode_payloads(_live(t))

    def part(payload, path, kind, name):
        return F.try_variant_get(payload, path, kind).alias(name)

    def total(payload, path, kind):
        entries = F.coalesce(F.try_variant_get(payload, path, f"array<struct<{kind}: bigint>>"), F.array())
        return F.aggregate(entries, F.lit(0).cast("bigint"), lambda a, e: a + e[kind])

    def number(payload, path):
        return F.coalesce(F.size(F.try_variant_get(payload, path, "array<variant>")), F.lit(0)).cast("bigint")

    return d.select(
        "run_id", *[f"{p}_undecodable" for p in RL.PAYLOADS], part("config", "$.company_name", "string", "config_company"),
        part("config", "$.scenario_count", "bigint", "config_scenarios"), part("results", "$.total_scenarios", "bigint", "payload_total"),
        part("results", "$.passed", "bigint", "payload_passed"), part("results", "$.failed", "bigint", "payload_failed"),
        part("results", "$.pass_rate", "double", "payload_pass_rate"), number("results", "$.results").alias("n_results"),
        number("analysis", "$.patterns").alias("n_patterns"), total("analysis", "$.patterns", "count").alias("pattern_failures"),
        number("fixes", "$.fixes").alias("n_fixes"), total("fixes", "$.fixes", "affected_scenarios").alias("fix_scenarios"))


@register("SRC06_list_runs", _LIVE + """
SELECT run_id, company_name, system_type, status, pass_rate, total_scenarios, total_failures,
       run_cost_usd, created_at, error_message
FROM live ORDER BY created_at DESC, run_id DESC LIMIT 100
""")
def src06_list_runs(t):
    """SRC-06: the 100 newest runs (the list endpoint's page size is the feature)."""
    return RL.list_runs(_live(t))


@register("W04_newest_runs", _LIVE + """
SELECT company_name, run_id, CAST(rank AS INT) AS run_rank FROM (
  SELECT company_name, run_id, ROW_NUMBER() OVER (PARTITION BY company_name ORDER BY created_at DESC, run_id DESC) AS rank
  FROM live) x WHERE rank <= 5
""")
def w04_newest_runs(t):
    """W-04: five newest runs per company."""
    return RL.newest_per_key(_live(t), "company_name", 5).select(
        "company_name", "run_id", F.col("run_rank").cast("int").alias("run_rank"))


@register("W03_latest_completed_run", _LIVE + """
SELECT company_name, arg_max(run_id, created_at) AS run_id, arg_max(pass_rate, created_at) AS pass_rate
FROM live WHERE status = 'completed' GROUP BY company_name
""")
def w03_latest_run(t):
    """W-03: latest completed run per company (one max_by aggregate)."""
    done = _live(t).where(F.col("status") == "completed").select("company_name", "run_id", "pass_rate", "created_at")
    return RL.latest_run(done, "company_name").select("company_name", "run_id", "pass_rate")


_HIST = _LIVE + """,
top AS (
  SELECT company_name, run_id, ROW_NUMBER() OVER (PARTITION BY company_name ORDER BY created_at DESC, run_id DESC) AS run_rank
  FROM live WHERE status = 'completed'),
h AS (
  SELECT top.company_name, top.run_id, top.run_rank, r.failure_type, COUNT(*) AS n, MIN(r.result_id) AS first_seq
  FROM top JOIN results r ON r.run_id = top.run_id
  WHERE top.run_rank <= 5 AND NOT r.passed AND r.failure_type IS NOT NULL
  GROUP BY ALL)
"""


@register("SRC07_run_history", _LIVE + """,
asks AS (SELECT company_name, run_id AS asking_run FROM live QUALIFY ROW_NUMBER() OVER (PARTITION BY company_name ORDER BY created_at DESC, run_id DESC) <= 3),
prior AS (
  SELECT a.company_name, a.asking_run, l.run_id, l.total_scenarios, l.total_failures,
         CAST(ROW_NUMBER() OVER (PARTITION BY a.asking_run ORDER BY l.created_at DESC, l.run_id DESC) AS INT) AS run_rank
  FROM asks a JOIN live l ON l.company_name = a.company_name AND l.run_id <> a.asking_run AND l.status = 'completed')
SELECT p.company_name, asking_run, p.run_id, run_rank, total_scenarios, total_failures AS failed, r.failure_type, r.n
FROM prior p LEFT JOIN (SELECT run_id, failure_type, COUNT(*) AS n FROM results WHERE NOT passed AND failure_type IS NOT NULL GROUP BY ALL) r
  ON r.run_id = p.run_id
WHERE run_rank <= 5
""")
def src07_run_history(t):
    """SRC-07: what each company's three newest runs are told of the five newest
    completed runs before or beside them, counted again from the stored results."""
    live = _live(t)
    asking = RL.newest_per_key(live.select("company_name", "run_id", "created_at"), "company_name", 3)
    prior = RL.previous_runs(live, asking)
    counted = RL.failure_breakdown(prior).select("asking_run", "run_id", "failure_type", "n")
    return (prior.join(counted, ["asking_run", "run_id"], "left")
            .select("company_name", "asking_run", "run_id", F.col("run_rank").cast("int").alias("run_rank"), "total_scenarios", "failed", "failure_type", "n"))


@register("A18_failure_context", _HIST + """
SELECT company_name AS company, failure_type, CAST(SUM(n) AS BIGINT) AS n,
       CAST(ROW_NUMBER() OVER (PARTITION BY company_name ORDER BY SUM(n) DESC, MIN({'r': run_rank, 's': first_seq})) AS INT) AS rank
FROM h GROUP BY company_name, failure_type
""")
def a18_failure_context(t):
    """A-18: failure types over each company's recent history, ranked."""
    live = _live(t).where(F.col("status") == "completed")
    top = RL.newest_per_key(live, "company_name", 5).select("company_name", "run_id", "run_rank")
    res = FX.results(t).where(~F.col("passed") & F.col("failure_type").isNotNull())
    hb = (top.join(res, "run_id").groupBy("company_name", "run_id", "run_rank", "failure_type")
             .agg(F.count(F.lit(1)).alias("n"), F.min("result_id").alias("first_seq"))
             .withColumnRenamed("company_name", "company"))
    return L.failure_context(hb).select("company", "failure_type", "n", F.col("rank").cast("int").alias("rank"))


@register("W06_run_trend", """
SELECT company, run_id, pass_rate, prev_pass_rate, pass_rate - prev_pass_rate AS delta,
       CASE WHEN prev_pass_rate IS NULL THEN NULL WHEN pass_rate - prev_pass_rate > 0 THEN 'improved' ELSE 'declined' END AS direction
FROM (SELECT company, run_id, pass_rate,
             LAG(pass_rate) OVER (PARTITION BY company ORDER BY created_at, run_id) AS prev_pass_rate
      FROM runs WHERE status = 'completed') x
""")
def w06_run_trend(t):
    """W-06: pass-rate delta vs the previous completed run of the company."""
    r = FX.runs(t).where(F.col("status") == "completed")
    return AN.run_trend(r).select("company", "run_id", "pass_rate", "prev_pass_rate", "delta", "direction")
