"""Registered query: scenario-generator prompts (PR-03, with K-06 context slices).

One prompt per (system, focus bucket, batch of <= 20): the bucket sizes come
from the scenario mix (P-16..P-18, P-24), personas from the weighted round
robin (J-08, restarting every batch), failure context from A-18 / A-12 /
A-19, language context from A-11 / A-09, policies from P-30.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as P
from ..operators import insights as I
from ..operators import learn as L
from ..operators import plan as PL
from ..sources import fixtures as FX
from . import params as PP
from . import q_plan as QPL
from . import q_rubric as QR
from .q_prompt import render_sql
from .registry import QUERIES, register

_SEQ_BUCKET = 1_000_000_000


def _lines(df, key, rank_col, text, k, header, name):
    """``header`` + newline + '- item' lines of the first k ranked items, per key."""
    top = df.where(F.col(rank_col) <= k)
    g = top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct(F.col(rank_col).alias("_r"), F.concat(F.lit("- "), text).alias("_t")))), lambda s: s["_t"]), "\n")
        .alias("_l"))
    return g.select(key, F.concat(F.lit(header + "\n"), F.col("_l")).alias(name))


def _batches(t):
    p = QPL._plan(t)
    b = p.select("company", F.explode(F.array(
        F.struct(F.lit(0).alias("b_ord"), F.lit("new_edge_cases").alias("focus"), F.col("mix.new_edge_cases").alias("n")),
        F.struct(F.lit(1).alias("b_ord"), F.lit("from_failures").alias("focus"), F.col("mix.from_failures").alias("n")),
        F.struct(F.lit(2).alias("b_ord"), F.lit("adversarial").alias("focus"), F.col("mix.adversarial").alias("n")),
    )).alias("b")).select("company", "b.*").where(F.col("n") > 0)
    bt = b.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / 20).cast("int") - 1)).alias("batch"))
    return bt.withColumn("size", F.least(F.lit(20), F.col("n") - 20 * F.col("batch")))


def generator_prompts(t):
    bt = _batches(t)
    slots = bt.select("company", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("pos"), "b_ord", "batch")
    slots = slots.select(F.col("company").alias("system"),
                         (F.col("b_ord") * _SEQ_BUCKET + F.col("batch") * 20 + F.col("pos")).alias("seq"))
    lib = QPL._persona_status(t)
    per = (QPL._systems(t).select(F.col("company").alias("system"), "system_type")
           .join(lib, "system_type").select("system", "persona", "persona_ord", "status"))
    assigned = PL.weighted_persona_slots(per, slots, key="system").select(
        F.col("system").alias("company"), (F.floor(F.col("seq") / _SEQ_BUCKET)).cast("int").alias("b_ord"),
        F.floor((F.col("seq") % _SEQ_BUCKET) / 20).cast("int").alias("batch"), (F.col("seq") % 20).alias("pos"),
        "persona")
    desc = F.concat(F.lit("Scenario "), (F.col("pos") + 1).cast("string"), F.lit(" — Write as: "), F.col("persona"),
                    F.lit("\n  Style: \n  Emotion: \n  Example phrases: "))
    pd_ = assigned.groupBy("company", "b_ord", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("pos", desc.alias("_d")))), lambda s: s["_d"]), "\n").alias("persona_descriptions"))

    # failure context (from_failures batches only)
    ft = QUERIES["A18_failure_context"].build(t)
    types = _lines(ft, "company", "rank", F.concat(F.col("failure_type"), F.lit(": "), F.col("n").cast("string"),
                                                   F.lit(" failures")), 5, P.FAILURE_TYPES_HEADER, "p_types")
    tiered = I.tier_messages(FX.conv(t))
    trig = _lines(I.failure_triggers(tiered), "company", "rank", F.col("text"), 10, P.TRIGGERS_HEADER, "p_trig")
    sysdf = QPL._systems(t).select("company", L.system_hash("system_type", "company").alias("system_hash"))
    hv = QUERIES["A19_high_value_patterns"].build(t).join(sysdf, "system_hash")
    hvl = _lines(hv, "company", "rank", F.col("pattern"), 5, P.HIGH_VALUE_HEADER, "p_hv")
    # language context
    lang = I.language_patterns(tiered, PP.TEST_INFORMAL_MARKERS).select(
        "company", F.concat(F.lit(P.LANGUAGE_HEADER), F.array_join(F.split("patterns", ","), ", "),
                            F.lit("\n" + P.LANGUAGE_TAIL)).alias("lang"))
    voc = I.vocabulary(tiered).where(F.col("rank") <= 20).groupBy("company").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]), ", ").alias("words"))
    pol = QUERIES["P30_policy_summary"].build(t).withColumnRenamed("system", "company")
    names = QR._systems(t).select(F.col("system").alias("company"), "company_name")
    sysinfo = QPL._systems(t).select("company", "industry", "system_type")

    j = (bt.join(pd_, ["company", "b_ord", "batch"]).join(sysinfo, "company").join(names, "company")
           .join(pol, "company", "left").join(types, "company", "left").join(trig, "company", "left")
           .join(hvl, "company", "left").join(lang, "company", "left").join(voc, "company", "left"))
    fsec = F.when(F.col("focus") == "from_failures", F.concat_ws("\n\n", "p_types", "p_trig", "p_hv")).otherwise(F.lit(""))
    lctx = F.concat(F.coalesce("lang", F.lit("")),
                    F.when(F.col("words").isNotNull(), F.concat(F.lit("\n" + P.VOCABULARY_HEADER), F.col("words")))
                    .otherwise(F.lit("")))
    diff = F.try_element_at(F.create_map(*[F.lit(x) for kv in P.DIFFICULTY_INSTRUCTIONS.items() for x in kv]),
                            F.col("focus"))
    prompt = P.render(P.GENERATOR_PROMPT, company="company_name", industry="industry", system_type="system_type",
                      description_line=F.lit(""), use_cases_line=F.lit(""), policy_summary="policy_summary",
                      failure_section=fsec, language_context=lctx, use_case_instruction=F.lit(""),
                      count="size", difficulty_instructions=diff, persona_descriptions="persona_descriptions")
    return j.select("company", "focus", F.col("batch").cast("int").alias("batch"), prompt.alias("prompt"))


def _body(name):
    return QUERIES[name].sql.strip()


_DIFF_SQL = "CASE focus " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.DIFFICULTY_INSTRUCTIONS.items()) + " END"

_SQL = "WITH " + QPL._SYSTEMS_SQL.strip() + "," + QPL._PERSONAS_SQL.strip() + f""",
mix AS (SELECT company, CASE WHEN n_triggers = 0 THEN n_new + n_fail ELSE n_new END AS new_edge_cases,
               CASE WHEN n_triggers = 0 THEN 0 ELSE n_fail END AS from_failures,
               GREATEST(0, effective_count - n_new - n_fail) AS adversarial FROM plan1),
bk AS (SELECT company, 0 AS b_ord, 'new_edge_cases' AS focus, new_edge_cases AS n FROM mix
       UNION ALL SELECT company, 1, 'from_failures', from_failures FROM mix
       UNION ALL SELECT company, 2, 'adversarial', adversarial FROM mix),
bt AS (SELECT company, b_ord, focus, n, unnest(generate_series(0, CAST(CEIL(n / 20.0) AS BIGINT) - 1)) AS batch FROM bk WHERE n > 0),
bs AS (SELECT *, LEAST(20, n - 20 * batch) AS size FROM bt),
sl AS (SELECT company, b_ord, batch, unnest(generate_series(0, size - 1)) AS pos FROM bs),
per AS (SELECT s.company, p.persona, p.persona_ord, p.status FROM systems s JOIN pst p ON p.system_type = s.system_type),
hv AS (SELECT company, persona, ROW_NUMBER() OVER (PARTITION BY company ORDER BY persona_ord) - 1 AS j FROM per WHERE status = 'high_value'),
khv AS (SELECT company, COUNT(*) AS k FROM hv GROUP BY company),
act AS (SELECT company, persona, ROW_NUMBER() OVER (PARTITION BY company ORDER BY persona_ord) - 1 AS j FROM per WHERE status = 'active'),
w AS (SELECT hv.company, persona, c.c * khv.k + hv.j AS widx FROM hv JOIN khv ON khv.company = hv.company
      CROSS JOIN (SELECT unnest([0, 1, 2]) AS c) c
      UNION ALL
      SELECT act.company, persona, 3 * COALESCE(khv.k, 0) + act.j FROM act LEFT JOIN khv ON khv.company = act.company),
sz AS (SELECT company, COUNT(*) AS n FROM w GROUP BY company),
pa AS (SELECT sl.company, sl.b_ord, sl.batch, sl.pos, w.persona FROM sl JOIN sz ON sz.company = sl.company
       JOIN w ON w.company = sl.company AND w.widx = sl.pos % sz.n),
pd AS (SELECT company, b_ord, batch, string_agg('Scenario ' || CAST(pos + 1 AS VARCHAR) || ' — Write as: ' || persona
                                                || chr(10) || '  Style: ' || chr(10) || '  Emotion: ' || chr(10) || '  Example phrases: ',
                                                chr(10) ORDER BY pos) AS persona_descriptions
       FROM pa GROUP BY company, b_ord, batch),
ftc AS ({_body("A18_failure_context")}),
ft5 AS (SELECT company, '{P.FAILURE_TYPES_HEADER}' || chr(10) || string_agg('- ' || failure_type || ': ' || CAST(n AS VARCHAR) || ' failures', chr(10) ORDER BY rank) AS p_types
        FROM ftc WHERE rank <= 5 GROUP BY company),
trc AS ({_body("A12_failure_triggers")}),
tr10 AS (SELECT company, '{P.TRIGGERS_HEADER}' || chr(10) || string_agg('- ' || text, chr(10) ORDER BY rank) AS p_trig
         FROM trc WHERE rank <= 10 GROUP BY company),
hvc AS ({_body("A19_high_value_patterns")}),
sh AS (SELECT company, substr(sha256(concat_ws('|', system_type, company, '', '', '', '')), 1, 16) AS system_hash FROM systems),
hv5 AS (SELECT sh.company, '{P.HIGH_VALUE_HEADER}' || chr(10) || string_agg('- ' || hvc.pattern, chr(10) ORDER BY hvc.rank) AS p_hv
        FROM hvc JOIN sh ON sh.system_hash = hvc.system_hash WHERE hvc.rank <= 5 GROUP BY sh.company),
lp AS ({_body("A11_language_patterns")}),
vc AS ({_body("A09_vocabulary")}),
vw AS (SELECT company, string_agg(word, ', ' ORDER BY rank) AS words FROM vc WHERE rank <= 20 GROUP BY company),
pol AS ({_body("P30_policy_summary")}),
nm AS (SELECT company, 'Company ' || CAST(CAST(substr(company, 4) AS INT) AS VARCHAR) AS company_name FROM systems),
x AS (SELECT bs.company, bs.focus, bs.batch, bs.size, s.industry, s.system_type, nm.company_name, pol.policy_summary, pd.persona_descriptions,
             CASE WHEN bs.focus = 'from_failures' THEN concat_ws(chr(10) || chr(10), ft5.p_types, tr10.p_trig, hv5.p_hv) ELSE '' END AS fsec,
             COALESCE('{P.LANGUAGE_HEADER}' || array_to_string(string_split(lp.patterns, ','), ', ') || chr(10) || '{P.LANGUAGE_TAIL}', '')
             || COALESCE(chr(10) || '{P.VOCABULARY_HEADER.replace("'", "''")}' || vw.words, '') AS lctx
      FROM bs JOIN pd ON pd.company = bs.company AND pd.b_ord = bs.b_ord AND pd.batch = bs.batch
      JOIN systems s ON s.company = bs.company JOIN nm ON nm.company = bs.company
      LEFT JOIN pol ON pol.system = bs.company LEFT JOIN ft5 ON ft5.company = bs.company LEFT JOIN tr10 ON tr10.company = bs.company
      LEFT JOIN hv5 ON hv5.company = bs.company LEFT JOIN lp ON lp.company = bs.company LEFT JOIN vw ON vw.company = bs.company)
SELECT company, focus, CAST(batch AS INT) AS batch,
       {render_sql(P.GENERATOR_PROMPT, company="company_name", industry="industry", system_type="system_type",
                   description_line="''", use_cases_line="''", policy_summary="policy_summary", failure_section="fsec",
                   language_context="lctx", use_case_instruction="''", count="size",
                   difficulty_instructions=_DIFF_SQL, persona_descriptions="persona_descriptions")} AS prompt
FROM x
"""


register("PR03_generator_prompts", _SQL)(generator_prompts)
generator_prompts.__doc__ = "PR-03: scenario-generator request per (system, focus bucket, batch of 20)."
