"""Registered queries: prompt tables and batch inference (PR-01, PR-06, PR-07, PR-08, PR-13, U-01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions.numeric import py_round_sql
from ..operators import analyze as AN
from ..operators import fix as FXO
from ..operators import judge as J
from ..operators import prompting as PM
from ..operators import rubric as RB
from ..sources import fixtures as FX
from . import params as PP
from . import q_fix as QFX
from . import q_rubric as _QR
from .registry import QUERIES, register

QUERIES_P04 = QUERIES["P04_result_assembly"].sql.strip()


def render_sql(template: str, **exprs) -> str:
    """The same template as DuckDB string concatenation (oracle side)."""
    import re
    out, pos = [], 0
    for m in re.finditer(r"\{\{|\}\}|\{([A-Za-z_][A-Za-z0-9_]*)\}", template):
        lit = template[pos:m.start()]
        if lit:
            out.append("'" + lit.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        tok = m.group(0)
        if tok in ("{{", "}}"):
            out.append("'" + tok[0] + "'")
        else:
            out.append(f"COALESCE(CAST(({exprs[m.group(1)]}) AS VARCHAR), '')")
        pos = m.end()
    tail = template[pos:]
    if tail:
        out.append("'" + tail.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
    return " || ".join(out)


def _judged(t):
    """Results of the bot replies (rules + panel), with scenario order."""
    ruled = J.apply_rules(FX.responses(t), prohibited_actions=PP.TEST_PROHIBITED_ACTIONS,
                          refusal_phrases=PP.TEST_REFUSAL_PHRASES)
    panel = J.panel_verdict(FX.verdicts(t), FX.panel_scenarios(t))
    return J.assemble_results(ruled, panel).withColumn("seq", F.col("scenario_id"))


_EXPECTED = "CONCAT('Answer the ', company, ' customer')"


@register("PR01_judge_prompts", _QR.RUBRIC_SQL + f"""
SELECT scenario_id, {render_sql(P.JUDGE_PROMPT, input="input", expected_behavior=_EXPECTED,
                                response="actual_response", suffix="rubric")} AS prompt
FROM responses JOIN rub ON rub.system = responses.company WHERE actual_response IS NOT NULL
""")
def pr01_judge_prompts(t):
    """PR-01: judge prompt for every scenario that got a reply, with its system's rubric."""
    return _judge_prompts(t)


def _judge_prompts(t):
    r = FX.responses(t).where(F.col("actual_response").isNotNull())
    r = _QR.policies(r, "scenario_id", "input", "actual_response",
                     F.concat(F.lit("Answer the "), F.col("company"), F.lit(" customer")).alias("expected_behavior"))
    return PM.judge_prompts(r, RB.rubric_text()).select("scenario_id", "prompt")


@register("U01_judge_inference")
def u01_inference(t):
    """U-01 + S-07 + A-03: judge prompts for each of the three judges, joined with the
    replies that are stored for them; replies parsed, panel verdict.  A prompt
    without a stored reply counts as a failed request."""
    prompts = _judge_prompts(t)
    slots = F.posexplode(F.array(F.lit("judge_a"), F.lit("judge_b"), F.lit("judge_c"))).alias("slot", "judge_model")
    per_judge = prompts.select("scenario_id", slots, "prompt")
    # scenario ids are conversation * 1000000 + turn; replies are numbered by conversation, turn and judge
    number = (F.expr("div(scenario_id, 1000000)") * 10 + F.col("scenario_id") % 1000000) * 3 + F.col("slot")
    replies = per_judge.withColumn("reply_id", number).join(FX.raw_replies(t).select("reply_id", "raw"), "reply_id", "left")
    v = J.parse_verdicts(replies.select("scenario_id", "slot", "judge_model", "raw")).where(F.col("valid"))
    return J.panel_verdict(v, prompts.select("scenario_id"))


def _failed_patterns(t):
    res = _judged(t)
    failed = (res.where(~F.col("passed")).withColumn("run", F.col("company"))
                 .withColumn("_key", F.coalesce(F.col("failure_type"), F.lit("UNKNOWN"))))
    pats = AN.patterns_by_type(failed, run_col="run").withColumn("_key", F.col("type_key"))
    return res, failed, pats


_RES = "WITH res AS (\n" + QUERIES_P04 + "\n)"
_TYPES = "('HALLUCINATION','POLICY_VIOLATION','INCOMPLETE','WRONG_ANSWER','CONTEXT_LOSS','ESCALATION_FAILURE')"


@register("PR06_cluster_label_prompts", _RES + f""",
f AS (SELECT scenario_id, company AS run, actual_response, COALESCE(failure_type, 'UNKNOWN') AS k FROM res WHERE NOT passed),
tot AS (SELECT run, COUNT(*) AS total FROM f GROUP BY run),
g AS (SELECT run, k, COUNT(*) AS n FROM f GROUP BY run, k),
ex AS (SELECT run, k, string_agg('- Input: ' || substr(actual_response, 1, 150), chr(10) ORDER BY scenario_id) AS examples
       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run, k ORDER BY scenario_id) AS rn FROM f) z WHERE rn <= 5 GROUP BY run, k)
SELECT g.run, g.k AS type_key,
       {render_sql(P.CLUSTER_LABEL_PROMPT, company="g.run", size="g.n",
                   failure_type=f"CASE WHEN g.k IN {_TYPES} THEN g.k ELSE 'WRONG_ANSWER' END",
                   pct=py_round_sql("g.n / CAST(tot.total AS DOUBLE) * 100", 1), examples="ex.examples")} AS prompt
FROM g JOIN tot ON tot.run = g.run JOIN ex ON ex.run = g.run AND ex.k = g.k
""")
def pr06_cluster_label_prompts(t):
    """PR-06: cluster-label prompt per failure pattern (first five example replies)."""
    _, failed, pats = _failed_patterns(t)
    out = PM.cluster_label_prompts(failed, pats.drop("examples").withColumn("company", F.col("run")), ["run", "_key"],
                                   company_col="company")
    return out.select("run", "type_key", "prompt")


@register("PR07_contrast_prompts", _RES + f""",
x AS (SELECT company AS run, scenario_id, passed, '- ' || substr(actual_response, 1, 100) AS line,
             ROW_NUMBER() OVER (PARTITION BY company, passed ORDER BY scenario_id) AS rn FROM res),
fl AS (SELECT run, string_agg(line, chr(10) ORDER BY scenario_id) AS t, COUNT(*) AS n FROM x WHERE NOT passed AND rn <= 10 GROUP BY run),
ps AS (SELECT run, string_agg(line, chr(10) ORDER BY scenario_id) AS t, COUNT(*) AS n FROM x WHERE passed AND rn <= 10 GROUP BY run)
SELECT fl.run, {render_sql(P.CONTRAST_PROMPT, company="fl.run", n_failed="fl.n", failed_text="fl.t",
                           n_passed="ps.n", passed_text="ps.t")} AS prompt
FROM fl JOIN ps ON ps.run = fl.run
""")
def pr07_contrast_prompts(t):
    """PR-07: contrast prompt per run (first 10 failed vs first 10 passed replies)."""
    res = _judged(t).withColumn("run", F.col("company"))
    return PM.contrast_prompts(res, "run")


@register("PR08_summary_prompts", _RES + f""",
st AS (SELECT company AS run, COUNT(*) AS total, SUM(CASE WHEN passed THEN 1 ELSE 0 END) AS passed_count,
              SUM(CASE WHEN passed THEN 0 ELSE 1 END) AS failed_count FROM res GROUP BY company),
f AS (SELECT scenario_id, company AS run, COALESCE(failure_type, 'UNKNOWN') AS k FROM res WHERE NOT passed),
g AS (SELECT run, k, COUNT(*) AS n, MIN(scenario_id) AS first FROM f GROUP BY run, k),
gt AS (SELECT g.*, {py_round_sql("g.n / CAST(SUM(g.n) OVER (PARTITION BY g.run) AS DOUBLE) * 100", 1)} AS pct,
              ROW_NUMBER() OVER (PARTITION BY run ORDER BY n DESC, first) AS rk FROM g),
pt AS (SELECT run, string_agg('- ' || lower(k) || ': ' || CAST(n AS VARCHAR) || ' failures (' || CAST(pct AS VARCHAR) || '%) — ', chr(10) ORDER BY rk) AS ptxt
       FROM gt WHERE rk <= 5 GROUP BY run)
SELECT st.run, {render_sql(P.SUMMARY_PROMPT, company="st.run",
                           pass_pct=py_round_sql(py_round_sql("st.passed_count / CAST(st.total AS DOUBLE)", 4) + " * 100", 1),
                           total="st.total", passed="st.passed_count", failed="st.failed_count", trend_text="''",
                           patterns_text="COALESCE(pt.ptxt, 'No significant patterns detected')",
                           contrast="'Not available'")} AS prompt
FROM st LEFT JOIN pt ON pt.run = st.run
""")
def pr08_summary_prompts(t):
    """PR-08: executive-summary prompt per run (stats, top-5 patterns, no trend, no contrast)."""
    res, failed, pats = _failed_patterns(t)
    stats = AN.run_statistics(res.withColumn("run", F.col("company")), run_col="run").withColumn("company", F.col("run"))
    p = pats.withColumn("cluster_label", F.lower("type_key")).withColumn("root_cause", F.lit(""))
    return PM.summary_prompts(stats, p, "run")


@register("PR13_improvement_prompts", QFX.report_sql(f"""
SELECT run_id, {render_sql(P.IMPROVEMENT_PROMPT, company="substr(run_id, 1, 4)", current_pct=py_round_sql("pr * 100", 1),
                           n_fixes="total_fixes", n_high="h", high_scenarios="hs", failures="failed_count")} AS prompt
FROM y WHERE total_fixes > 0
"""))
def pr13_improvement_prompts(t):
    """PR-13: improvement-estimate prompt per run from the fix report numbers."""
    fixes, stats = QFX._fixes(t)
    company = F.substring_index("run_id", "_", 2).alias("company")
    return PM.improvement_prompts(FXO.fix_report(fixes, stats), stats.select("*", company), "run_id")


def _fix_prompt_inputs(t):
    from . import q_rubric as QR
    _, failed, pats = _failed_patterns(t)
    s = QR._systems(t)
    kw = F.concat(F.lit("["), F.array_join(F.transform("escalate_on_keywords",
                                                       lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    policy = F.concat_ws("\n",
                         F.when(F.coalesce(F.col("refund_threshold"), F.lit(0.0)) != 0,
                                F.concat(F.lit("Refund threshold: $"), F.col("refund_threshold").cast("string"))),
                         F.when(F.size("escalate_on_keywords") > 0, F.concat(F.lit("Escalation keywords: "), kw)))
    k = F.col("k")
    retrieval = F.when(F.col("system_type") == "RAG", F.concat(
        F.lit("Current strategy: "), F.when(k % 2 == 1, F.lit("hybrid")).otherwise(F.lit("semantic")),
        F.lit("\nTop-k: "), (k + 3).cast("string"),
        F.lit("\nConfidence threshold: "), (k.cast("double") / 10 + 0.5).cast("string"),
        F.lit("\nReranking enabled: "), F.when(k % 3 == 1, F.lit("True")).otherwise(F.lit("False"))))
    ctx = s.select(F.col("system").alias("run"), F.col("company_name").alias("company"), "system_type",
                   policy.alias("policy_context"), retrieval.alias("retrieval_context"))
    p = pats.join(ctx, "run").select("run", "pattern_rank", "failure_type", F.lower("type_key").alias("cluster_label"),
                                    "scenario_count", F.lit("").alias("root_cause"), F.lit("").alias("evidence"),
                                    "examples", "company", "system_type", "policy_context", "retrieval_context")
    return FXO.fix_plan(p)


_SYS_BODY = _QR._SYS_SQL.strip()


@register("PR09_PR12_fix_prompts", _RES + ",\n" + _SYS_BODY + f""",
f AS (SELECT scenario_id, company AS run, actual_response, COALESCE(failure_type, 'UNKNOWN') AS k FROM res WHERE NOT passed),
g AS (SELECT run, k, COUNT(*) AS n, MIN(scenario_id) AS first FROM f GROUP BY run, k),
gr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run ORDER BY n DESC, first) AS pattern_rank,
              CASE WHEN k IN {_TYPES} THEN k ELSE 'WRONG_ANSWER' END AS failure_type FROM g),
ex AS (SELECT run, k, string_agg('- ' || substr(actual_response, 1, 100), chr(10) ORDER BY scenario_id) AS examples
       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run, k ORDER BY scenario_id) AS rn FROM f) z WHERE rn <= 3 GROUP BY run, k),
ctx AS (SELECT system AS run, company_name AS company, system_type,
               concat_ws(chr(10), CASE WHEN COALESCE(refund_threshold, 0) <> 0 THEN 'Refund threshold: $' || CAST(refund_threshold AS VARCHAR) END,
                         CASE WHEN len(escalate_on_keywords) > 0 THEN 'Escalation keywords: [' || array_to_string(list_transform(escalate_on_keywords, lambda x: '''' || x || ''''), ', ') || ']' END) AS policy_context,
               CASE WHEN system_type = 'RAG' THEN 'Current strategy: ' || CASE WHEN k % 2 = 1 THEN 'hybrid' ELSE 'semantic' END
                    || chr(10) || 'Top-k: ' || CAST(k + 3 AS VARCHAR) || chr(10) || 'Confidence threshold: ' || CAST(CAST(k AS DOUBLE) / 10 + 0.5 AS VARCHAR)
                    || chr(10) || 'Reranking enabled: ' || CASE WHEN k % 3 = 1 THEN 'True' ELSE 'False' END END AS retrieval_context
        FROM sys),
p AS (SELECT gr.run, gr.pattern_rank, gr.failure_type, lower(gr.k) AS cluster_label, gr.n AS scenario_count, ex.examples,
             ctx.company, ctx.system_type, ctx.policy_context, ctx.retrieval_context,
             CASE WHEN gr.failure_type IN ('POLICY_VIOLATION','ESCALATION_FAILURE','HALLUCINATION') THEN 'HIGH'
                  WHEN gr.failure_type = 'CONTEXT_LOSS' THEN 'LOW' ELSE 'MEDIUM' END AS prio
      FROM gr JOIN ex ON ex.run = gr.run AND ex.k = gr.k JOIN ctx ON ctx.run = gr.run),
plan AS (SELECT *, 'PROMPT_ADDITION' AS fix_type FROM p
         UNION ALL SELECT *, 'GUARDRAIL_RULE' FROM p
         UNION ALL SELECT *, 'ARCHITECTURE_CHANGE' FROM p WHERE system_type = 'RAG'
         UNION ALL SELECT *, 'POLICY_CLARIFICATION' FROM p WHERE failure_type = 'POLICY_VIOLATION')
SELECT run, CAST(pattern_rank AS INT) AS pattern_rank, fix_type,
  CASE fix_type
    WHEN 'PROMPT_ADDITION' THEN {render_sql(P.PROMPT_FIX_PROMPT, system_type="replace(lower(system_type), '_', ' ')",
                                             company="company", failure_type="failure_type", cluster_label="cluster_label",
                                             scenario_count="scenario_count", root_cause="''", evidence="''", examples="examples",
                                             policy_block="CASE WHEN COALESCE(policy_context, '') <> '' THEN 'KNOWN POLICIES:' || chr(10) || policy_context ELSE '' END")}
    WHEN 'GUARDRAIL_RULE' THEN {render_sql(P.GUARDRAIL_FIX_PROMPT, company="company", failure_type="failure_type",
                                            root_cause="''", evidence="''", examples="examples")}
    WHEN 'ARCHITECTURE_CHANGE' THEN {render_sql(P.ARCHITECTURE_FIX_PROMPT, failure_type="failure_type", root_cause="''", evidence="''",
                                                 retrieval_block="CASE WHEN COALESCE(retrieval_context, '') <> '' THEN 'CURRENT RETRIEVAL CONFIG:' || chr(10) || retrieval_context ELSE '' END")}
    ELSE {render_sql(P.POLICY_FIX_PROMPT, company="company", failure_type="failure_type", root_cause="''", evidence="''",
                     examples="examples")}
  END AS prompt
FROM plan
""")
def pr09_pr12_fix_prompts(t):
    """PR-09..PR-12: prompt-addition, guardrail, architecture and policy-clarification requests per planned fix."""
    from ..operators import prompting as PMO
    out = PMO.fix_prompts(_fix_prompt_inputs(t))
    return out.select("run", F.col("pattern_rank").cast("int").alias("pattern_rank"), "fix_type", "prompt")


def _batches(t):
    """Scenarios of every run in batches of 20 (W-02), with 1-based positions in the batch."""
    from . import q_learn as QL
    j = QL._joined(t)
    b = J.assign_batches(j, order_col="result_id")
    k = F.substring("run_id", 4, 1).cast("int")
    return b.withColumn("deployment", F.when(k % 2 == 0, "PRE_DEPLOYMENT").otherwise("POST_DEPLOYMENT"))


def _with_pos(b):
    from pyspark.sql import Window
    w = Window.partitionBy("run_id", "batch_id").orderBy("result_id")
    return b.withColumn("pos", F.row_number().over(w))


_BATCH_SQL = """
b AS (SELECT r.run_id, r.result_id, sc.input, sc.expected_behavior, sc.difficulty,
             CASE WHEN CAST(substr(r.run_id, 4, 1) AS INT) % 2 = 0 THEN 'PRE_DEPLOYMENT' ELSE 'POST_DEPLOYMENT' END AS deployment,
             CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY r.run_id ORDER BY r.result_id) - 1) / 20) AS BIGINT) AS batch_id
      FROM results r JOIN scenarios sc ON sc.scenario_id = r.scenario_id),
bp AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id, batch_id ORDER BY result_id) AS pos FROM b)
"""


@register("PR04_critic_prompts", "WITH " + _BATCH_SQL.strip() + f""",
l AS (SELECT run_id, batch_id, deployment, COUNT(*) AS n,
             string_agg('Scenario ' || CAST(pos AS VARCHAR) || ':' || chr(10) || 'Input: ' || input || chr(10) || 'Expected: '
                        || expected_behavior || chr(10) || 'Difficulty: ' || difficulty, chr(10) || chr(10) ORDER BY pos) AS lst
      FROM bp GROUP BY run_id, batch_id, deployment)
SELECT run_id, batch_id, {render_sql(P.CRITIC_PROMPT, evaluation_context=f"CASE WHEN deployment = 'PRE_DEPLOYMENT' THEN '{P.CRITIC_CONTEXT_PRE}' ELSE '{P.CRITIC_CONTEXT_POST}' END",
                                     n="n", scenario_list="lst")} AS prompt
FROM l
""")
def pr04_critic_prompts(t):
    """PR-04: critic request per batch of 20 generated scenarios."""
    b = _with_pos(_batches(t))
    return PM.critic_prompts(b, ["run_id", "batch_id"])


@register("PR05_regenerate_prompts", "WITH " + _BATCH_SQL.strip() + f""",
rej AS (SELECT run_id, batch_id, input, CASE WHEN difficulty = 'EASY' THEN 'too generic' ELSE '' END AS feedback,
               ROW_NUMBER() OVER (PARTITION BY run_id, batch_id ORDER BY result_id) AS pos
        FROM bp WHERE difficulty IN ('EASY', 'MEDIUM')),
l AS (SELECT run_id, batch_id, COUNT(*) AS n, string_agg(CAST(pos AS VARCHAR) || '. Input: ' || input, chr(10) ORDER BY pos) AS lst,
             COALESCE(string_agg(CASE WHEN feedback <> '' THEN 'Scenario ' || CAST(pos AS VARCHAR) || ' feedback: ' || feedback END, chr(10) ORDER BY pos), '') AS fb
      FROM rej GROUP BY run_id, batch_id)
SELECT run_id, batch_id, {render_sql(P.REGENERATE_PROMPT, scenario_list="lst", feedback="fb", n="n")} AS prompt
FROM l
""")
def pr05_regenerate_prompts(t):
    """PR-05: regenerate request per batch for the scenarios the critic rejected
    (here: the EASY and MEDIUM ones; EASY ones carry feedback), with their feedback."""
    b = _batches(t).where(F.col("difficulty").isin("EASY", "MEDIUM"))
    b = _with_pos(b).withColumn("feedback", F.when(F.col("difficulty") == "EASY", F.lit("too generic"))
                                .otherwise(F.lit("")))
    return PM.regenerate_prompts(b, ["run_id", "batch_id"])


@register("W05_first_examples", _RES + """,
f AS (SELECT scenario_id, company AS run, actual_response, COALESCE(failure_type, 'UNKNOWN') AS k FROM res WHERE NOT passed),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run, k ORDER BY scenario_id) AS rn FROM f)
SELECT run, k AS type_key, string_agg(substr(actual_response, 1, 100), chr(10) ORDER BY rn) AS examples
FROM r WHERE rn <= 3 GROUP BY run, k
""")
def w05_first_examples(t):
    """W-05: first three example replies (100-char prefixes) per failure group, in input order."""
    _, failed, pats = _failed_patterns(t)
    return pats.select("run", "type_key", F.array_join("examples", "\n").alias("examples"))
