"""Registered queries: scenario planning (P-16..P-18, P-21, P-23, P-24, J-03, J-08, J-10, K-03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insights as I
from ..operators import learn as L
from ..operators import plan as PL
from ..sources import fixtures as FX
from ..sources import runlog as RL
from ..session import cut_lineage
from .registry import register

# --- derived planning inputs -------------------------------------------------
_SYSTEMS_SQL = """
systems AS (
  SELECT company, CAST(substr(company, 4) AS INT) AS k,
         CASE CAST(substr(company, 4) AS INT) % 3 WHEN 0 THEN 'CUSTOMER_SUPPORT' WHEN 1 THEN 'RAG' ELSE 'MULTI_AGENT' END AS system_type,
         CASE CAST(substr(company, 4) AS INT) % 3 WHEN 0 THEN 'retail' WHEN 1 THEN 'saas' ELSE 'fintech' END AS industry,
         CASE WHEN CAST(substr(company, 4) AS INT) % 2 = 0 THEN 'PRE_DEPLOYMENT' ELSE 'POST_DEPLOYMENT' END AS deployment,
         200 AS max_scenarios
  FROM (SELECT DISTINCT company FROM runs) c),
latest AS (SELECT company, arg_max(pass_rate, {'c': created_at, 'r': run_id}) AS latest_rate
           FROM runs WHERE status = 'completed' GROUP BY company),
trig AS (SELECT company, COUNT(DISTINCT content) AS n_triggers FROM conv
         WHERE content IS NOT NULL AND content <> '' AND length(content) > 20 AND outcome IS NOT NULL AND outcome <> ''
           AND role = 'user' AND (contains(lower(outcome), 'bad') OR contains(lower(outcome), 'wrong') OR contains(lower(outcome), 'fail')
             OR contains(lower(outcome), 'incorrect') OR contains(lower(outcome), 'violation') OR contains(lower(outcome), 'error'))
         GROUP BY company),
known AS (SELECT company, COUNT(DISTINCT failure_type) AS n_known FROM results
          WHERE NOT passed AND failure_type IS NOT NULL GROUP BY company),
plan0 AS (
  SELECT s.*, l.latest_rate IS NOT NULL AS has_history, l.latest_rate,
         CASE WHEN deployment = 'PRE_DEPLOYMENT' AND max_scenarios = 200 THEN 500 ELSE max_scenarios END AS effective_count,
         CASE WHEN l.latest_rate IS NULL THEN 'NEW' WHEN l.latest_rate >= 0.85 THEN 'RELIABLE' ELSE 'RUNNING' END AS maturity,
         COALESCE(t.n_triggers, 0) AS n_triggers, COALESCE(kn.n_known, 0) AS n_known
  FROM systems s LEFT JOIN latest l ON l.company = s.company LEFT JOIN trig t ON t.company = s.company
  LEFT JOIN known kn ON kn.company = s.company),
plan1 AS (
  SELECT *, CAST(TRUNC(effective_count * CASE maturity WHEN 'NEW' THEN 1.0 WHEN 'RUNNING' THEN 0.5 ELSE 0.2 END) AS INT) AS n_new,
         CAST(TRUNC(effective_count * CASE maturity WHEN 'NEW' THEN 0.0 WHEN 'RUNNING' THEN 0.3 ELSE 0.6 END) AS INT) AS n_fail
  FROM plan0)
"""


def _systems(t):
    runs = FX.runs(t)
    comp = runs.select("company").distinct()
    k = F.substring("company", 4, 8).cast("int")
    sysdf = comp.select(
        "company", k.alias("k"),
        F.when(k % 3 == 0, "CUSTOMER_SUPPORT").when(k % 3 == 1, "RAG").otherwise("MULTI_AGENT").alias("system_type"),
        F.when(k % 3 == 0, "retail").when(k % 3 == 1, "saas").otherwise("fintech").alias("industry"),
        F.when(k % 2 == 0, "PRE_DEPLOYMENT").otherwise("POST_DEPLOYMENT").alias("deployment"),
        F.lit(200).alias("max_scenarios"))
    latest = RL.latest_run(runs.where(F.col("status") == "completed")
                           .select("company", "run_id", "pass_rate", "created_at"), "company") \
        .select("company", F.col("pass_rate").alias("latest_rate"))
    trig = I.failure_trigger_counts(I.tier_messages(FX.conv(t)))
    known = (FX.results(t).where(~F.col("passed") & F.col("failure_type").isNotNull())
             .groupBy("company").agg(F.count_distinct("failure_type").alias("n_known")))
    return cut_lineage(sysdf.join(latest, "company", "left").join(trig, "company", "left")
                       .join(known, "company", "left"), "systems")


def _plan(t):
    s = _systems(t)
    eff = PL.effective_count(F.col("deployment"), F.col("max_scenarios"))
    mat = PL.maturity(F.col("latest_rate").isNotNull(), F.col("latest_rate"), F.lit("NEW"))
    s = s.select("*", eff.alias("effective_count"), mat.alias("maturity"))
    mix = PL.scenario_mix(F.col("effective_count"), F.col("maturity"), F.lit("SMART_MIX"))
    mix = PL.failure_focus_fallback(mix, F.col("n_triggers"), F.col("n_known"))
    return s.withColumn("mix", mix)


@register("P16_P18_scenario_mix", "WITH " + _SYSTEMS_SQL.strip() + """
SELECT company, effective_count, maturity,
       CASE WHEN n_triggers = 0 AND n_known = 0 THEN n_new + n_fail ELSE n_new END AS new_edge_cases,
       CASE WHEN n_triggers = 0 AND n_known = 0 THEN 0 ELSE n_fail END AS from_failures,
       GREATEST(0, effective_count - n_new - n_fail) AS adversarial
FROM plan1
""")
def p16_p18_mix(t):
    """P-16/P-17/P-18/P-24: effective count, maturity and the scenario mix per system."""
    p = _plan(t)
    return p.select("company", F.col("effective_count").cast("int").alias("effective_count"), "maturity",
                    F.col("mix.new_edge_cases").alias("new_edge_cases"),
                    F.col("mix.from_failures").alias("from_failures"),
                    F.col("mix.adversarial").alias("adversarial"))


@register("P23_persona_pool_size", """
SELECT company, CASE WHEN n > 0 THEN 40 ELSE 20 END AS persona_total
FROM (SELECT company, COUNT(*) AS n FROM conv GROUP BY company) x
""")
def p23_persona_total(t):
    """P-23: persona pool size by context (conversations given, no description)."""
    c = FX.conv(t).groupBy("company").agg(F.count(F.lit(1)).alias("n"))
    return c.select("company", PL.persona_total(F.lit(False), F.col("n") > 0).alias("persona_total"))


# persona library derived from the personas seen in persona_use
_PERSONAS_SQL = """
lib AS (
  SELECT DISTINCT persona, CAST(substr(persona, 3) AS INT) AS persona_ord,
         CASE CAST(substr(persona, 3) AS INT) % 3 WHEN 0 THEN ['retail', 'saas'] WHEN 1 THEN ['fintech'] ELSE ['Retail', 'delivery'] END AS industries
  FROM persona_use),
eff AS (SELECT persona, system_type, COUNT(*) AS times_used, SUM(CASE WHEN found_failure THEN 1 ELSE 0 END) AS failures
        FROM persona_use GROUP BY ALL),
pst AS (
  SELECT l.persona, l.persona_ord, l.industries, st.system_type,
         CASE WHEN e.times_used IS NULL THEN 'active' WHEN 5 * e.failures >= 2 * e.times_used THEN 'high_value'
              WHEN 20 * e.failures <= e.times_used AND e.times_used >= 5 THEN 'retired' ELSE 'active' END AS status
  FROM lib l CROSS JOIN (SELECT DISTINCT system_type FROM persona_use) st
  LEFT JOIN eff e ON e.persona = l.persona AND e.system_type = st.system_type)
"""


def _library(t):
    pu = FX.persona_use(t)
    n = F.substring("persona", 3, 8).cast("int")
    ind = (F.when(n % 3 == 0, F.array(F.lit("retail"), F.lit("saas")))
            .when(n % 3 == 1, F.array(F.lit("fintech")))
            .otherwise(F.array(F.lit("Retail"), F.lit("delivery"))))
    # one library row per (persona, system type) seen in the data
    lib = pu.select("persona", "system_type").distinct().select(
        "persona", "system_type", n.alias("persona_ord"), ind.alias("industries"), F.lit("active").alias("status"))
    return lib


def _persona_status(t):
    """Persona status per (persona, system type): a small table, written once
    (so the events table is scanned once however often the plan refers to it)."""
    eff = L.persona_effectiveness(FX.persona_use(t))
    return cut_lineage(PL.persona_status(_library(t), eff), "persona_status")


@register("J03_persona_status", "WITH " + _PERSONAS_SQL.strip() + """
SELECT persona, system_type, status FROM pst
""")
def j03_persona_status(t):
    """J-03: persona library status from learned effectiveness."""
    return _persona_status(t).select("persona", "system_type", "status")


@register("J10_persona_order", "WITH " + _SYSTEMS_SQL.strip() + "," + _PERSONAS_SQL.strip() + """
SELECT s.company, p.persona,
       CAST(ROW_NUMBER() OVER (PARTITION BY s.company ORDER BY list_contains(list_transform(p.industries, lambda x: lower(x)), lower(s.industry)) DESC, p.persona_ord) AS INT) AS rank
FROM systems s JOIN pst p ON p.system_type = s.system_type
""")
def j10_persona_order(t):
    """J-10: personas per system, industry-relevant first, library order kept."""
    lib = _library(t)
    sysdf = _systems(t).select(F.col("company").alias("system"), "system_type", "industry")
    r = PL.rank_personas(lib, sysdf, key="system")
    return r.select(F.col("system").alias("company"), "persona", F.col("rank").cast("int").alias("rank"))


@register("J08_persona_slots", "WITH " + _SYSTEMS_SQL.strip() + "," + _PERSONAS_SQL.strip() + """,
per AS (SELECT s.company, p.persona, p.persona_ord, p.status FROM systems s JOIN pst p ON p.system_type = s.system_type),
hv AS (SELECT company, persona, ROW_NUMBER() OVER (PARTITION BY company ORDER BY persona_ord) - 1 AS j FROM per WHERE status = 'high_value'),
khv AS (SELECT company, COUNT(*) AS k FROM hv GROUP BY company),
act AS (SELECT company, persona, ROW_NUMBER() OVER (PARTITION BY company ORDER BY persona_ord) - 1 AS j FROM per WHERE status = 'active'),
w AS (SELECT hv.company, persona, c.c * khv.k + hv.j AS widx FROM hv JOIN khv ON khv.company = hv.company
      CROSS JOIN (SELECT unnest([0, 1, 2]) AS c) c
      UNION ALL
      SELECT act.company, persona, 3 * COALESCE(khv.k, 0) + act.j FROM act LEFT JOIN khv ON khv.company = act.company),
sz AS (SELECT company, COUNT(*) AS n FROM w GROUP BY company),
slots AS (SELECT company, unnest(generate_series(0, effective_count - 1)) AS seq FROM plan1)
SELECT slots.company, CAST(slots.seq AS INT) AS seq, w.persona
FROM slots JOIN sz ON sz.company = slots.company JOIN w ON w.company = slots.company AND w.widx = (slots.seq % 20) % sz.n
""")
def j08_persona_slots(t):
    """J-08: persona of every planned scenario slot (weighted round robin per batch of 20)."""
    p = _plan(t)
    slots = p.select(F.col("company").alias("system"),
                     F.explode(F.sequence(F.lit(0), F.col("effective_count") - 1)).alias("seq"))
    lib = _persona_status(t)
    per = (_systems(t).select(F.col("company").alias("system"), "system_type")
           .join(lib, "system_type").select("system", "persona", "persona_ord", "status"))
    out = PL.weighted_persona_slots(per, slots, key="system")
    return out.select(F.col("system").alias("company"), F.col("seq").cast("int").alias("seq"), "persona")


_CRITIC = """
cand AS (SELECT l_orderkey AS batch_id, l_linenumber AS slot FROM lineitem),
sc AS (
  SELECT l_orderkey AS batch_id, 1 AS attempt, l_linenumber AS slot, l_quantity / 10.0 AS average FROM lineitem WHERE l_linenumber <> 7
  UNION ALL SELECT l_orderkey, 2, l_linenumber, (l_quantity + l_partkey % 10) / 10.0 FROM lineitem
  UNION ALL SELECT l_orderkey, 3, l_linenumber, (l_quantity + l_suppkey % 20) / 10.0 FROM lineitem),
"""


def _critic_inputs(t):
    li = t.lineitem
    cand = li.select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("slot"))
    s1 = li.where(F.col("l_linenumber") != 7).select(
        F.col("l_orderkey").alias("batch_id"), F.lit(1).alias("attempt"), F.col("l_linenumber").alias("slot"),
        (F.col("l_quantity") / 10.0).alias("average"))
    s2 = li.select(F.col("l_orderkey").alias("batch_id"), F.lit(2).alias("attempt"), F.col("l_linenumber").alias("slot"),
                   ((F.col("l_quantity") + F.col("l_partkey") % 10) / 10.0).alias("average"))
    s3 = li.select(F.col("l_orderkey").alias("batch_id"), F.lit(3).alias("attempt"), F.col("l_linenumber").alias("slot"),
                   ((F.col("l_quantity") + F.col("l_suppkey") % 20) / 10.0).alias("average"))
    return cand, s1.unionByName(s2).unionByName(s3)


def _critic_sql():
    parts = []
    prev = "cand"
    for a in (1, 2, 3):
        last = a == 3
        parts.append(f"""
p{a} AS (SELECT batch_id, slot FROM {prev}),
cp{a} AS (SELECT batch_id, COUNT(*) AS np FROM p{a} GROUP BY batch_id),
cs{a} AS (SELECT batch_id, COUNT(*) AS ns FROM sc WHERE attempt = {a} GROUP BY batch_id),
j{a} AS (SELECT p.batch_id, p.slot,
               COALESCE(cs.ns, 0) <> cp.np OR COALESCE(s.average, 0) >= 3.5 AS ok
        FROM p{a} p LEFT JOIN sc s ON s.batch_id = p.batch_id AND s.slot = p.slot AND s.attempt = {a}
        LEFT JOIN cp{a} cp ON cp.batch_id = p.batch_id LEFT JOIN cs{a} cs ON cs.batch_id = p.batch_id),
d{a} AS (SELECT batch_id, slot, {a} AS attempt, CASE WHEN ok THEN 'approved' ELSE {"'below_threshold'" if last else 'NULL'} END AS outcome FROM j{a}),
r{a} AS (SELECT batch_id, slot FROM d{a} WHERE outcome IS NULL)""")
        prev = f"r{a}"
    return "WITH " + _CRITIC.strip() + ",".join(parts) + """
SELECT batch_id, slot, attempt, outcome FROM d1 WHERE outcome IS NOT NULL
UNION ALL SELECT batch_id, slot, attempt, outcome FROM d2 WHERE outcome IS NOT NULL
UNION ALL SELECT batch_id, slot, attempt, outcome FROM d3 WHERE outcome IS NOT NULL
"""


@register("P21_critic_gate", _critic_sql())
def p21_critic_gate(t):
    """P-21: critic approval per candidate over up to three attempts."""
    cand, scores = _critic_inputs(t)
    return PL.critic_gate(cand, scores)


@register("K03_cut_to_count", """
WITH c AS (SELECT DISTINCT company, CAST(substr(company, 4) AS INT) AS k FROM results),
m AS (SELECT *, CASE k WHEN 0 THEN 200 ELSE 20 * k END AS max_scenarios FROM c),
e AS (SELECT company, CASE WHEN k % 2 = 0 AND max_scenarios = 200 THEN 500 ELSE max_scenarios END AS effective_count FROM m)
SELECT r.run_id, COUNT(*) AS kept FROM (
  SELECT run_id, company, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY result_id) AS rn FROM results) r
JOIN e ON e.company = r.company WHERE rn <= e.effective_count GROUP BY r.run_id
""")
def k03_cut(t):
    """K-03: keep the first scenarios of each run, as many as P-16's effective count of its system."""
    res = FX.results(t).withColumn("seq", F.col("result_id"))
    k = F.substring("company", 4, 8).cast("int")
    deployment = F.when(k % 2 == 0, "PRE_DEPLOYMENT").otherwise("POST_DEPLOYMENT")
    count = PL.effective_count(deployment, F.when(k == 0, 200).otherwise(20 * k))
    return PL.cut_to_count(res, count).groupBy("run_id").agg(F.count(F.lit(1)).alias("kept"))


@register("P08_persona_pools", "WITH " + _SYSTEMS_SQL.strip() + "," + _PERSONAS_SQL.strip() + """
SELECT s.company, CAST(SUM(CASE WHEN p.status = 'high_value' THEN 1 ELSE 0 END) AS BIGINT) AS high_value,
       CAST(SUM(CASE WHEN p.status = 'active' THEN 1 ELSE 0 END) AS BIGINT) AS active,
       CAST(3 * SUM(CASE WHEN p.status = 'high_value' THEN 1 ELSE 0 END) + SUM(CASE WHEN p.status = 'active' THEN 1 ELSE 0 END) AS BIGINT) AS weighted_len
FROM systems s JOIN pst p ON p.system_type = s.system_type WHERE p.status <> 'retired' GROUP BY s.company
""")
def p08_persona_pools(t):
    """P-08: persona pools per system after the status filter (retired dropped)."""
    lib = _persona_status(t)
    per = (_systems(t).select(F.col("company").alias("system"), "system_type")
           .join(lib, "system_type").select("system", "persona", "status"))
    return PL.persona_pools(per).withColumnRenamed("system", "company")
