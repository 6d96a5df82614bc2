"""Registered queries: remaining inventory rows (S-12, SRC-13, P-20, J-09, U-set-2,
U-set-4, K-05/K-06, A-40, C-01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import py_round_sql
from ..operators import analyze as AN
from ..operators import cluster as C
from ..operators import fix as FXO
from ..operators import insights as I
from ..operators import replies as RO
from ..operators import report as R
from ..sources import fixtures as FX
from . import q_fix as QF
from . import q_learn as QL
from . import q_parse as QP
from . import q_plan as QPL
from . import q_rubric as QR
from .registry import QUERIES, register


def _body(name: str) -> str:
    return QUERIES[name].sql.strip()


# --------------------------------------------------------------------- S-12
@register("S12_fix_reply_parse", QF._PAT + """,
rp AS (SELECT *, CASE (pattern_rank + fo) % 3
         WHEN 0 THEN '{"title": "Fix ' || CAST(pattern_rank AS VARCHAR) || '", "problem": "p", "suggested_fix": "do x", "estimated_impact": "some", "implementation_steps": ["one", "two"], "verification_scenarios": ["check"]}'
         WHEN 1 THEN '```json' || chr(10) || '{"title": "Only title"}' || chr(10) || '```'
         ELSE 'sorry, no json' END AS raw FROM plan),
s AS (SELECT *, CASE WHEN starts_with(trim(raw), '```') THEN trim(regexp_replace(split_part(trim(raw), '```', 2), '^json', '')) ELSE trim(raw) END AS js0 FROM rp),
v AS (SELECT *, CASE WHEN json_valid(js0) AND json_type(js0) = 'OBJECT' THEN js0 END AS js FROM s)
SELECT run_id, CAST(pattern_rank AS INT) AS pattern_rank, fix_type,
       COALESCE(json_extract_string(js, '$.title'), CASE fix_type WHEN 'PROMPT_ADDITION' THEN 'Prompt improvement suggestion'
                WHEN 'GUARDRAIL_RULE' THEN 'Guardrail rule suggestion' WHEN 'ARCHITECTURE_CHANGE' THEN 'Architecture improvement'
                ELSE 'Policy clarification needed' END) AS title,
       COALESCE(json_extract_string(js, '$.problem'), '') AS problem,
       COALESCE(json_extract_string(js, '$.suggested_fix'), '') AS suggested_fix,
       COALESCE(json_extract_string(js, '$.estimated_impact'), '') AS estimated_impact,
       COALESCE(array_to_string(json_extract_string(js, '$.implementation_steps[*]'), '|'), '') AS implementation_steps,
       COALESCE(array_to_string(json_extract_string(js, '$.verification_scenarios[*]'), '|'), '') AS verification_scenarios
FROM v WHERE js IS NOT NULL
""")
def s12_fix_replies(t):
    """S-12: model replies merged into planned fixes with per-type defaults; malformed replies drop the fix."""
    plan = FXO.fix_plan(QF._patterns(t))
    fo = (F.when(F.col("fix_type") == "PROMPT_ADDITION", 0).when(F.col("fix_type") == "GUARDRAIL_RULE", 1)
           .when(F.col("fix_type") == "ARCHITECTURE_CHANGE", 2).otherwise(3))
    k = (F.col("pattern_rank") + fo) % 3
    raw = (F.when(k == 0, F.concat(F.lit('{"title": "Fix '), F.col("pattern_rank").cast("string"),
                                   F.lit('", "problem": "p", "suggested_fix": "do x", "estimated_impact": "some", '
                                         '"implementation_steps": ["one", "two"], "verification_scenarios": ["check"]}')))
            .when(k == 1, F.lit('```json\n{"title": "Only title"}\n```'))
            .otherwise(F.lit("sorry, no json")))
    replies = plan.select("run_id", "pattern_rank", "fix_type", raw.alias("raw"))
    out = FXO.apply_fix_replies(plan.withColumn("root_cause", F.lit("")), replies)
    return out.select("run_id", F.col("pattern_rank").cast("int").alias("pattern_rank"), "fix_type", "title",
                      "problem", "suggested_fix", "estimated_impact",
                      F.array_join("implementation_steps", "|").alias("implementation_steps"),
                      F.array_join("verification_scenarios", "|").alias("verification_scenarios"))


# --------------------------------------------------------------------- SRC-13
@register("SRC13_finetune_json_records", QL._JOINED + """
SELECT scenario_id, CAST(json_object('input', input, 'wrong_output', actual_response, 'correct_output', expected_behavior, 'failure_type', failure_type,
                                     'difficulty', difficulty, 'tags', tags, 'system_config_hash', system_hash) AS VARCHAR) AS value
FROM j WHERE NOT passed AND failure_type IS NOT NULL
""")
def src13_json_records(t):
    """SRC-13: full fine-tuning pairs as JSON records (one object per line)."""
    from ..operators import learn as L
    p = L.finetuning_pairs(QL._joined(t))
    return p.select("scenario_id", F.to_json(F.struct(
        "input", "wrong_output", "correct_output", "failure_type", "difficulty", "tags",
        F.col("system_hash").alias("system_config_hash"))).alias("value"))


# --------------------------------------------------------------------- P-20
@register("P20_active_config", "WITH " + QR._SYS_SQL.strip() + """
SELECT system, system_type,
       CASE system_type WHEN 'CUSTOMER_SUPPORT' THEN 'support' WHEN 'RAG' THEN 'rag' WHEN 'MULTI_AGENT' THEN 'agent' END AS active_kind,
       CASE system_type WHEN 'CUSTOMER_SUPPORT' THEN refund_threshold WHEN 'RAG' THEN hallucination_tolerance
                        WHEN 'MULTI_AGENT' THEN max_cost_per_run END AS key_limit
FROM sys
""")
def p20_active_config(t):
    """P-20: the active configuration struct of each system, chosen by its type."""
    s = QR._systems(t)
    support = F.struct(F.lit("support").alias("kind"), F.col("refund_threshold").alias("limit"))
    rag = F.struct(F.lit("rag").alias("kind"), F.col("hallucination_tolerance").alias("limit"))
    agent = F.struct(F.lit("agent").alias("kind"), F.col("max_cost_per_run").alias("limit"))
    st = F.col("system_type")
    active = (F.when(st == "CUSTOMER_SUPPORT", support).when(st == "RAG", rag).when(st == "MULTI_AGENT", agent))
    return s.select("system", "system_type", active["kind"].alias("active_kind"), active["limit"].alias("key_limit"))


# --------------------------------------------------------------------- J-09
@register("J09_positional_zip", """
WITH sc AS (""" + _body("S08_scenario_reply_parse") + """),
cr AS (""" + _body("S09_critic_scores") + """)
SELECT sc.reply_id, sc.item_no, sc.input, cr.average
FROM sc JOIN cr ON cr.reply_id = sc.reply_id AND cr.slot = sc.item_no
""")
def j09_zip(t):
    """J-09: scenario items paired with the critic score at the same position (join on (batch, slot))."""
    sc = RO.parse_scenarios(QP._gen_replies(t), ["reply_id"])
    cr = RO.parse_critic_scores(QP._crit_replies(t), ["reply_id"], expected_col="expected")
    j = sc.join(cr, (sc.reply_id == cr.reply_id) & (sc.item_no == cr.slot))
    return j.select(sc.reply_id, sc.item_no.cast("int").alias("item_no"), "input", "average")


# --------------------------------------------------------------------- U-set-2
@register("USET2_scenario_union", "WITH mix AS (" + _body("P16_P18_scenario_mix") + """)
SELECT company, bucket, n FROM (
  SELECT company, 'new_edge_cases' AS bucket, new_edge_cases AS n FROM mix
  UNION ALL SELECT company, 'from_failures', from_failures FROM mix
  UNION ALL SELECT company, 'adversarial', adversarial FROM mix) x WHERE n > 0
""")
def uset2_union(t):
    """U-set-2: the run's scenario list = new ∪ failure ∪ adversarial batches (slot rows, counted)."""
    p = QPL._plan(t)
    parts = []
    for b in ("new_edge_cases", "from_failures", "adversarial"):
        parts.append(p.select("company", F.lit(b).alias("bucket"),
                              F.explode(F.sequence(F.lit(1), F.col(f"mix.{b}"))).alias("slot"))
                      .where(F.col(f"mix.{b}") > 0))
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("company", "bucket").agg(F.count(F.lit(1)).cast("int").alias("n"))


# --------------------------------------------------------------------- U-set-4
@register("USET4_distinct_failure_types", """
SELECT run_id, string_agg(DISTINCT failure_type, ',' ORDER BY failure_type) AS failure_types
FROM results WHERE NOT passed AND failure_type IS NOT NULL GROUP BY run_id
""")
def uset4_types(t):
    """U-set-4: distinct failure types of each run (at most the enum size per run)."""
    r = FX.results(t).where(~F.col("passed") & F.col("failure_type").isNotNull())
    return r.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("failure_type")), ",").alias("failure_types"))


# --------------------------------------------------------------------- K-05/K-06
@register("K06_generator_context", """
WITH ft AS (""" + _body("A18_failure_context") + """),
vo AS (""" + _body("A09_vocabulary") + """),
tr AS (""" + _body("A12_failure_triggers") + """),
cf AS (SELECT company, string_agg(failure_type, ', ' ORDER BY rank) AS top_failure_types FROM ft WHERE rank <= 5 GROUP BY company),
cv AS (SELECT company, string_agg(word, ', ' ORDER BY rank) AS top_words FROM vo WHERE rank <= 20 GROUP BY company),
ct AS (SELECT company, COUNT(*) AS n_triggers FROM tr WHERE rank <= 10 GROUP BY company)
SELECT cv.company, cf.top_failure_types, cv.top_words, COALESCE(ct.n_triggers, 0) AS n_triggers
FROM cv LEFT JOIN cf ON cf.company = cv.company LEFT JOIN ct ON ct.company = cv.company
""")
def k06_context(t):
    """K-05/K-06: generator prompt context per company — top 5 failure types, 20 words, 10 triggers."""
    ft = QUERIES["A18_failure_context"].build(t)
    tiered = I.tier_messages(FX.conv(t))
    vo = I.vocabulary(tiered)
    tr = I.failure_triggers(tiered)

    def joined(df, col, k, name):
        return (df.where(F.col("rank") <= k).groupBy("company").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", col))), lambda s: s[col]), ", ")
            .alias(name)))
    cf = joined(ft, "failure_type", 5, "top_failure_types")
    cv = joined(vo, "word", 20, "top_words")
    ct = tr.where(F.col("rank") <= 10).groupBy("company").agg(F.count(F.lit(1)).alias("n_triggers"))
    return (cv.join(cf, "company", "left").join(ct, "company", "left")
              .select("company", "top_failure_types", "top_words",
                      F.coalesce("n_triggers", F.lit(0)).cast("bigint").alias("n_triggers")))


# --------------------------------------------------------------------- A-40
@register("A40_integration_summary", QF.report_sql(f"""
, bd AS (SELECT run_id, string_agg(failure_type || ':' || CAST(n AS VARCHAR), ',' ORDER BY failure_type) AS failure_breakdown
         FROM (SELECT run_id, failure_type, COUNT(*) AS n FROM results WHERE NOT passed AND failure_type IS NOT NULL GROUP BY ALL) z GROUP BY run_id),
pj AS (SELECT run_id, '[' || string_agg(CAST(json_object('cluster_label', lower(type_key), 'failure_type', failure_type, 'scenario_count', affected_scenarios,
              'root_cause', '', 'immediate_fix', '', 'suggested_priority', prio) AS VARCHAR), ',' ORDER BY pattern_rank) || ']' AS failure_patterns,
              COUNT(*) AS n_patterns FROM pp GROUP BY run_id),
fj AS (SELECT run_id, '[' || string_agg(CAST(json_object('title', title, 'fix_type', fix_type, 'problem', problem, 'suggested_fix', suggested_fix,
              'priority', priority, 'estimated_impact', impact) AS VARCHAR), ',' ORDER BY fix_rank) || ']' AS fixes
       FROM told WHERE fix_rank <= 10 GROUP BY run_id)
SELECT y.run_id, y.pr AS pass_rate, {py_round_sql("y.pr * 100", 1)} AS pass_rate_percent, total AS total_scenarios,
       total - failed_count AS passed, failed_count AS failed, COALESCE(bd.failure_breakdown, '') AS failure_breakdown,
       COALESCE(pj.failure_patterns, '[]') AS failure_patterns,
       'Analysis complete. Pass rate: ' || CAST({py_round_sql("y.pr * 100", 1)} AS VARCHAR) || '%. ' || CAST(failed_count AS VARCHAR)
         || ' failures detected across ' || CAST(COALESCE(n_patterns, 0) AS VARCHAR) || ' patterns.' AS insight_summary,
       CAST(total_fixes AS BIGINT) AS total_fixes, CAST(h AS BIGINT) AS high_priority_fixes, COALESCE(fj.fixes, '[]') AS fixes, {QF.ESTIMATE_SQL} AS estimated_improvement
FROM y LEFT JOIN bd ON bd.run_id = y.run_id LEFT JOIN pj ON pj.run_id = y.run_id LEFT JOIN fj ON fj.run_id = y.run_id
"""))
def a40_summary(t):
    """A-40: one summary row per run - rate, percent, counts, breakdown, patterns, summary text, first 10 fixes, estimate."""
    res = FX.results(t)
    pats = QF._patterns(t).withColumnRenamed("affected_scenarios", "scenario_count").withColumn("immediate_fix", F.lit(""))
    fixes, stats = QF._fixes(t)
    bd = AN.breakdown_text(AN.failure_breakdown(res)).drop("breakdown_map")
    told = AN.summary_fallback(stats, pats.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_patterns")))
    return R.integration_summary(stats, bd, pats, told, fixes, FXO.fix_report(fixes, stats))


# --------------------------------------------------------------------- C-01
@register("C01_text_embeddings")
def c01_text_embeddings(t):
    """C-01 fallback: hashed TF-IDF embeddings (L2-normalised) of every bot reply."""
    r = FX.responses(t).where(F.col("actual_response").isNotNull())
    e = C.text_embeddings(r.select("scenario_id", "actual_response"), dim=256)
    return e.select("scenario_id", F.size("embedding").alias("dim"),
                    F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x).alias("norm2"))
