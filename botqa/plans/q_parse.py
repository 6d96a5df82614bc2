"""Registered queries: request/reply handling, batches, budget, judges, validation
and small string functions (P-01, P-02, P-10..P-12, P-22, W-01, W-02, J-05, J-06,
S-08..S-11, S-13..S-17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import grades as G
from ..functions import replies as RP
from ..functions import text as TX
from ..operators import judge as J
from ..operators import replies as RO
from ..sources import fixtures as FX
from ..sources import pages as PG
from .registry import register


@register("P01_request_body", """
SELECT scenario_id, CAST(json_object('message', input, 'channel', 'web', 'company', company) AS VARCHAR) AS request_body
FROM responses
""")
def p01_request_body(t):
    """P-01: JSON request body per scenario: message field, then extra fields."""
    extra = F.create_map(F.lit("channel"), F.lit("web"), F.lit("company"), F.col("company"))
    return J.request_body(FX.responses(t), extra_fields=extra).select("scenario_id", "request_body")


@register("P01_extra_field_wins", """
SELECT scenario_id, CAST(json_object('message', company) AS VARCHAR) AS request_body FROM responses
""")
def p01_extra_wins(t):
    """P-01: an extra field named like the message field replaces it."""
    extra = F.create_map(F.lit("message"), F.col("company"))
    return J.request_body(FX.responses(t), extra_fields=extra).select("scenario_id", "request_body")


@register("P02_reply_path", """
WITH b AS (SELECT scenario_id, CASE WHEN actual_response IS NULL THEN NULL
                                    ELSE CAST(json_object('data', json_object('reply', actual_response), 'n', 1) AS VARCHAR) END AS body
           FROM responses)
SELECT scenario_id,
       CASE WHEN body IS NULL THEN NULL ELSE COALESCE(json_extract_string(body, '$.data.reply'), '') END AS reply,
       CASE WHEN body IS NULL THEN NULL ELSE COALESCE(json_extract_string(body, '$.data.missing'), '') END AS missing_key,
       CASE WHEN body IS NULL THEN NULL ELSE COALESCE(json_extract_string(body, '$.n.deeper'), '') END AS through_scalar
FROM b
""")
def p02_reply_path(t):
    """P-02: dotted-path extraction from the JSON reply body ('' when missing, null without reply)."""
    r = FX.responses(t)
    body = F.when(F.col("actual_response").isNotNull(), F.to_json(F.struct(
        F.struct(F.col("actual_response").alias("reply")).alias("data"), F.lit(1).alias("n"))))
    b = r.select("scenario_id", body.alias("body"))
    return b.select("scenario_id", RP.reply_path("body", "data.reply").alias("reply"),
                    RP.reply_path("body", "data.missing").alias("missing_key"),
                    RP.reply_path("body", "n.deeper").alias("through_scalar"))


@register("W02_batches", """
SELECT run_id, result_id, CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY result_id) - 1) / 20) AS BIGINT) AS batch_id
FROM results
""")
def w02_batches(t):
    """W-02: batch of 20 of every scenario within its run."""
    return J.assign_batches(FX.results(t), order_col="result_id").select("run_id", "result_id", "batch_id")


_BUDGET = """
WITH b AS (SELECT run_id, result_id, tokens, CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY result_id) - 1) / 20) AS BIGINT) AS batch_id FROM results),
c AS (SELECT run_id, batch_id, SUM(tokens) / 1000.0 * CAST(0.003 AS DOUBLE) AS batch_cost FROM b GROUP BY ALL),
bud AS (SELECT DISTINCT run_id, CASE CAST(substr(run_id, 4, 1) AS INT) % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(0.0 AS DOUBLE)
                                   ELSE CAST(0.25 AS DOUBLE) END AS budget_usd FROM results),
s AS (SELECT c.*, bud.budget_usd,
             COALESCE(SUM(batch_cost) OVER (PARTITION BY c.run_id ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS spent_before
      FROM c JOIN bud ON bud.run_id = c.run_id)
SELECT run_id, batch_id, spent_before, budget_usd IS NULL OR budget_usd = 0 OR spent_before < budget_usd AS kept FROM s
"""


@register("W01_budget_cutoff", _BUDGET)
def w01_budget(t):
    """W-01: batches that start while spending is below the run budget (null/0 = no limit)."""
    res = J.assign_batches(FX.results(t), order_col="result_id")
    costs = res.groupBy("run_id", "batch_id").agg(
        (F.sum("tokens") / 1000.0 * F.lit(S.PRICE_PER_1K_TOKENS)).alias("batch_cost"))
    k = F.substring("run_id", 4, 1).cast("int") % 3
    budgets = FX.results(t).select("run_id").distinct().select(
        "run_id", F.when(k == 0, F.lit(None).cast("double")).when(k == 1, F.lit(0.0)).otherwise(F.lit(0.25))
        .alias("budget_usd"))
    return J.budget_cutoff(costs, budgets).select("run_id", "batch_id", "spent_before", "kept")


_TARGETS = """
targets AS (SELECT DISTINCT run_id AS target_id,
                   CASE CAST(substr(run_id, 4, 1) AS INT) % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'google' END AS target_family,
                   CASE CAST(substr(run_id, 9, 1) AS INT) % 3 WHEN 0 THEN 'frontier' WHEN 1 THEN 'standard' ELSE 'light' END AS target_tier
            FROM results),
judges AS (SELECT * FROM (VALUES ('prometheus-eval/prometheus-bgb-8x7b-v2.0', 'specialized', 2),
                                 ('gpt-5', 'openai', 1), ('claude-sonnet-4-6', 'anthropic', 2)) v(model, family, tier_order))
"""


def _targets(t):
    r = FX.results(t).select("run_id").distinct()
    k = F.substring("run_id", 4, 1).cast("int") % 3
    q = F.substring("run_id", 9, 1).cast("int") % 3
    return r.select(F.col("run_id").alias("target_id"),
                    F.when(k == 0, "openai").when(k == 1, "anthropic").otherwise("google").alias("target_family"),
                    F.when(q == 0, "frontier").when(q == 1, "standard").otherwise("light").alias("target_tier"),
                    F.array(F.lit(S.FIXED_FIRST_JUDGE)).alias("excluded"))


@register("J05_judge_eligibility", "WITH " + _TARGETS.strip() + """
SELECT target_id, model FROM targets JOIN judges
  ON (judges.family = 'specialized' OR judges.family <> targets.target_family)
 AND model <> 'prometheus-eval/prometheus-bgb-8x7b-v2.0'
 AND tier_order <= CASE target_tier WHEN 'frontier' THEN 1 WHEN 'standard' THEN 2 WHEN 'light' THEN 3 ELSE 2 END
""")
def j05_eligibility(t):
    """J-05: eligible judges per target (family, tier, exclusions); the judge pool is an exploded literal."""
    return J.eligible_judges(_targets(t)).select("target_id", "model")


@register("J06_panel_assignment")
def j06_assignment(t):
    """J-06: three-judge panel per target: fixed first judge + seeded picks (tier relaxed if needed)."""
    return J.assign_panels(_targets(t).drop("excluded"), seed=42)


@register("P10_row_validation", """
WITH c AS (SELECT run_id, COUNT(*) AS n FROM results GROUP BY run_id)
SELECT r.run_id, (r.confidence_score BETWEEN 0 AND 1) AND c.n BETWEEN 5 AND 500 AND r.scenario_id IS NOT NULL AS valid, COUNT(*) AS rows
FROM results r JOIN c ON c.run_id = r.run_id GROUP BY ALL
""")
def p10_validation(t):
    """P-10: valid / quarantine split (confidence in [0,1], 5..500 scenarios per run, required ids)."""
    r = FX.results(t)
    n = r.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    ok = (F.col("confidence_score").between(0, 1) & F.col("n").between(5, 500) & F.col("scenario_id").isNotNull())
    return r.join(n, "run_id").groupBy("run_id", ok.alias("valid")).agg(F.count(F.lit(1)).alias("rows"))


@register("P11_enum_coercion", """
WITH x AS (SELECT reply_id, CASE reply_id % 4 WHEN 0 THEN 'HALLUCINATION' WHEN 1 THEN 'hallucination' WHEN 2 THEN 'NOT_A_TYPE' END AS raw_type FROM raw_replies)
SELECT reply_id, raw_type,
       CASE WHEN raw_type IN ('HALLUCINATION','POLICY_VIOLATION','INCOMPLETE','WRONG_ANSWER','CONTEXT_LOSS','ESCALATION_FAILURE') THEN raw_type END AS judge_type,
       CASE WHEN raw_type IN ('HALLUCINATION','POLICY_VIOLATION','INCOMPLETE','WRONG_ANSWER','CONTEXT_LOSS','ESCALATION_FAILURE') THEN raw_type ELSE 'WRONG_ANSWER' END AS cluster_type
FROM x
""")
def p11_enum(t):
    """P-11: enum coercion — unknown failure type -> null (judge) or WRONG_ANSWER (cluster)."""
    r = FX.raw_replies(t)
    m = F.col("reply_id") % 4
    raw = F.when(m == 0, "HALLUCINATION").when(m == 1, "hallucination").when(m == 2, "NOT_A_TYPE")
    x = r.select("reply_id", raw.alias("raw_type"))
    return x.select("reply_id", "raw_type", RP.coerce_enum("raw_type", S.FAILURE_TYPES).alias("judge_type"),
                    RP.coerce_enum("raw_type", S.FAILURE_TYPES, "WRONG_ANSWER").alias("cluster_type"))


@register("P12_default_priority", """
SELECT COALESCE(failure_type, 'UNKNOWN') AS failure_type,
       CASE WHEN failure_type IN ('POLICY_VIOLATION','ESCALATION_FAILURE','HALLUCINATION') THEN 'HIGH'
            WHEN failure_type IN ('WRONG_ANSWER','INCOMPLETE') THEN 'MEDIUM' WHEN failure_type = 'CONTEXT_LOSS' THEN 'LOW'
            ELSE 'MEDIUM' END AS priority, COUNT(*) AS n
FROM results WHERE NOT passed GROUP BY ALL
""")
def p12_priority(t):
    """P-12: default priority of each failed result's type (unknown -> MEDIUM)."""
    r = FX.results(t).where(~F.col("passed"))
    return r.groupBy(F.coalesce("failure_type", F.lit("UNKNOWN")).alias("failure_type"),
                     G.default_priority("failure_type").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@register("S14_comma_list", """
WITH x AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ','), lambda e: regexp_replace(e, '^\\s+|\\s+$', '', 'g')),
                                              lambda e: e <> '') AS items FROM conversations)
SELECT conv_id, turn, CAST(len(items) AS INT) AS n_items, items[1] AS first_item FROM x
""")
def s14_comma_list(t):
    """S-14: comma list -> trimmed, non-empty items."""
    c = t.conversations
    items = F.filter(F.transform(F.split("text", ","), lambda e: TX.py_strip(e)), lambda e: e != "")
    x = c.select("conv_id", "turn", items.alias("items"))
    return x.select("conv_id", "turn", F.size("items").alias("n_items"), F.get("items", 0).alias("first_item"))


@register("S15_sorted_tag_key", """
SELECT scenario_id, array_to_string(list_sort(CASE WHEN tag_list = '' THEN [] ELSE string_split(tag_list, '|') END), '|') AS tag_key
FROM scenarios
""")
def s15_tag_key(t):
    """S-15: tags sorted and joined by '|'."""
    s = FX.scenarios(t)
    tags = F.when(F.col("tag_list") == "", F.array().cast("array<string>")).otherwise(F.split("tag_list", r"\|"))
    return s.select("scenario_id", TX.sorted_tag_key(tags).alias("tag_key"))


@register("S17_slug_label", """
SELECT conv_id, turn, substr(replace(text, ' ', '_'), 1, 30) AS slug, lower(replace(role || '_x_y', '_', ' ')) AS label
FROM conversations
""")
def s17_slug(t):
    """S-17: slug (spaces -> '_', 30 chars) and label ('_' -> space, lower)."""
    c = t.conversations
    return c.select("conv_id", "turn", TX.slug("text").alias("slug"),
                    TX.unslug_lower(F.concat("role", F.lit("_x_y"))).alias("label"))


@register("P22_prefixes", """
SELECT doc_id, substr(text, 1, 100) AS p100, substr(text, 1, 2000) AS p2000, CAST(length(substr(text, 1, 3000)) AS INT) AS n3000
FROM documents
""")
def p22_prefix(t):
    """P-22: prefix projections (100 / 2000 / 3000 chars)."""
    d = t.documents
    return d.select("doc_id", TX.prefix("text", 100).alias("p100"), TX.prefix("text", 2000).alias("p2000"),
                    F.length(TX.prefix("text", 3000)).alias("n3000"))


_META = """
WITH m AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"id": "", "file_id": "f' || CAST(doc_id AS VARCHAR) || '"}'
                              WHEN 1 THEN '{"document_id": "d' || CAST(doc_id AS VARCHAR) || '", "path": "/x"}'
                              ELSE '{"path": "/p/' || CAST(doc_id AS VARCHAR) || '"}' END AS meta FROM documents)
"""


@register("S13_first_truthy_id", _META + """
SELECT doc_id, COALESCE(NULLIF(json_extract_string(meta, '$.id'), ''), NULLIF(json_extract_string(meta, '$.document_id'), ''),
                        NULLIF(json_extract_string(meta, '$.file_id'), ''), NULLIF(json_extract_string(meta, '$.path'), '')) AS ref
FROM m
""")
def s13_first_truthy(t):
    """S-13: first truthy of id / document_id / file_id / path."""
    d = t.documents
    k = F.col("doc_id") % 3
    meta = (F.when(k == 0, F.concat(F.lit('{"id": "", "file_id": "f'), F.col("doc_id").cast("string"), F.lit('"}')))
             .when(k == 1, F.concat(F.lit('{"document_id": "d'), F.col("doc_id").cast("string"), F.lit('", "path": "/x"}')))
             .otherwise(F.concat(F.lit('{"path": "/p/'), F.col("doc_id").cast("string"), F.lit('"}'))))
    return d.select("doc_id", PG.first_id(meta).alias("ref"))


_GEN = """
WITH g AS (SELECT o_orderkey AS reply_id, CASE o_orderkey % 4
  WHEN 0 THEN '```json' || chr(10) || '[{"input": "q' || CAST(o_orderkey AS VARCHAR) || '", "expected_behavior": "e", "difficulty": "HARD", "tags": ["t1", "t2"]}, {"input": "r", "expected_behavior": "f"}]' || chr(10) || '```'
  WHEN 1 THEN '[{"input": "x", "expected_behavior": "y", "difficulty": "IMPOSSIBLE"}, "oops", {"input": 5, "expected_behavior": "z"}, {"expected_behavior": "only"}, {"input": "ok", "expected_behavior": "fine", "difficulty": "EASY"}]'
  WHEN 2 THEN 'not json at all'
  ELSE '[{"input": "a' || CAST(o_orderkey % 100 AS VARCHAR) || '", "expected_behavior": "b", "tags": []}]' END AS raw FROM orders)
"""


def _gen_replies(t):
    o = t.orders
    k = F.col("o_orderkey")
    nl = F.lit("\n")
    raw = (F.when(k % 4 == 0, F.concat(F.lit("```json"), nl, F.lit('[{"input": "q'), k.cast("string"),
                                       F.lit('", "expected_behavior": "e", "difficulty": "HARD", "tags": ["t1", "t2"]}, '
                                             '{"input": "r", "expected_behavior": "f"}]'), nl, F.lit("```")))
            .when(k % 4 == 1, F.lit('[{"input": "x", "expected_behavior": "y", "difficulty": "IMPOSSIBLE"}, "oops", '
                                    '{"input": 5, "expected_behavior": "z"}, {"expected_behavior": "only"}, '
                                    '{"input": "ok", "expected_behavior": "fine", "difficulty": "EASY"}]'))
            .when(k % 4 == 2, F.lit("not json at all"))
            .otherwise(F.concat(F.lit('[{"input": "a'), (k % 100).cast("string"),
                                F.lit('", "expected_behavior": "b", "tags": []}]'))))
    return o.select(k.alias("reply_id"), raw.alias("raw"))


def _items_sql(src: str) -> str:
    return f"""
s AS (SELECT reply_id, CASE WHEN starts_with(trim(raw), '```') THEN trim(regexp_replace(split_part(trim(raw), '```', 2), '^json', '')) ELSE trim(raw) END AS js FROM {src}),
v AS (SELECT reply_id, CASE WHEN json_valid(js) THEN js END AS js FROM s),
a AS (SELECT reply_id, js FROM v WHERE json_type(js) = 'ARRAY'),
it AS (SELECT reply_id, unnest(generate_series(0, CAST(json_array_length(js) AS BIGINT) - 1)) AS item_no, js FROM a),
items AS (SELECT reply_id, item_no, json_extract(js, '$[' || CAST(item_no AS VARCHAR) || ']') AS item FROM it)
"""


@register("S08_scenario_reply_parse", _GEN + "," + _items_sql("g") + """
SELECT reply_id, CAST(item_no AS INT) AS item_no, json_extract_string(item, '$.input') AS input,
       json_extract_string(item, '$.expected_behavior') AS expected_behavior,
       COALESCE(json_extract_string(item, '$.difficulty'), 'MEDIUM') AS difficulty,
       array_to_string(COALESCE(CAST(json_extract(item, '$.tags') AS VARCHAR[]), []), ',') AS tags
FROM items
WHERE json_type(item) = 'OBJECT' AND json_type(item, '$.input') = 'VARCHAR' AND json_type(item, '$.expected_behavior') = 'VARCHAR'
  AND (json_type(item, '$.difficulty') IS NULL OR json_extract_string(item, '$.difficulty') IN ('EASY','MEDIUM','HARD','ADVERSARIAL'))
""")
def s08_scenarios(t):
    """S-08: generator replies -> scenario rows; bad items skipped, defaults MEDIUM / []."""
    p = RO.parse_scenarios(_gen_replies(t), ["reply_id"])
    return p.select("reply_id", F.col("item_no").cast("int").alias("item_no"), "input", "expected_behavior",
                    "difficulty", F.array_join("tags", ",").alias("tags"))


_CRIT = """
WITH g AS (SELECT o_orderkey AS reply_id, 2 + CAST(o_orderkey % 2 AS INT) AS expected, CASE o_orderkey % 3
  WHEN 0 THEN '[{"average": 4.5, "feedback": "good"}, {"average": 2.0, "feedback": "weak"}]'
  WHEN 1 THEN '```' || chr(10) || '[{"average": 3.5}, {"feedback": "none"}, {"average": 1}]' || chr(10) || '```'
  ELSE 'the critic is unavailable' END AS raw FROM orders)
"""


def _crit_replies(t):
    o = t.orders
    k = F.col("o_orderkey")
    raw = (F.when(k % 3 == 0, F.lit('[{"average": 4.5, "feedback": "good"}, {"average": 2.0, "feedback": "weak"}]'))
            .when(k % 3 == 1, F.concat(F.lit("```\n"), F.lit('[{"average": 3.5}, {"feedback": "none"}, {"average": 1}]'),
                                       F.lit("\n```")))
            .otherwise(F.lit("the critic is unavailable")))
    return o.select(k.alias("reply_id"), (F.lit(2) + (k % 2)).cast("int").alias("expected"), raw.alias("raw"))


@register("S09_critic_scores", _CRIT + "," + _items_sql("g") + """,
good AS (SELECT a.reply_id FROM a JOIN g ON g.reply_id = a.reply_id WHERE json_array_length(a.js) = g.expected)
SELECT i.reply_id, CAST(i.item_no AS INT) AS slot, COALESCE(CAST(json_extract(i.item, '$.average') AS DOUBLE), 0.0) AS average,
       COALESCE(json_extract_string(i.item, '$.feedback'), '') AS feedback
FROM items i WHERE i.reply_id IN (SELECT reply_id FROM good)
UNION ALL
SELECT reply_id, CAST(unnest(generate_series(0, expected - 1)) AS INT) AS slot, CAST(5.0 AS DOUBLE) AS average, '' AS feedback
FROM g WHERE reply_id NOT IN (SELECT reply_id FROM good)
""")
def s09_critic_scores(t):
    """S-09: critic replies -> per-slot scores; unparsable or wrong-length replies score 5.0."""
    p = RO.parse_critic_scores(_crit_replies(t), ["reply_id"], expected_col="expected")
    return p.select("reply_id", F.col("slot").cast("int").alias("slot"), "average", "feedback")


_GROUNDED = """
WITH g AS (SELECT o_orderkey AS reply_id, CASE o_orderkey % 3
  WHEN 0 THEN '[{"question": "What is ' || CAST(o_orderkey AS VARCHAR) || '?", "correct_answer": "It is.", "source_chunk": "c", "question_type": "COMPLEX", "difficulty": "HARD"}, {"question": "Q2", "correct_answer": "A2"}]'
  WHEN 1 THEN '[{"question": "Q", "correct_answer": "A", "question_type": "simple"}, {"question": "Q3"}, {"question": "Q4", "correct_answer": "A4", "question_type": "DOUBLE"}]'
  ELSE '{"question": "not an array"}' END AS raw FROM orders)
"""


def _grounded_replies(t):
    o = t.orders
    k = F.col("o_orderkey")
    raw = (F.when(k % 3 == 0, F.concat(F.lit('[{"question": "What is '), k.cast("string"),
                                       F.lit('?", "correct_answer": "It is.", "source_chunk": "c", "question_type": "COMPLEX", '
                                             '"difficulty": "HARD"}, {"question": "Q2", "correct_answer": "A2"}]')))
            .when(k % 3 == 1, F.lit('[{"question": "Q", "correct_answer": "A", "question_type": "simple"}, {"question": "Q3"}, '
                                    '{"question": "Q4", "correct_answer": "A4", "question_type": "DOUBLE"}]'))
            .otherwise(F.lit('{"question": "not an array"}')))
    return o.select(k.alias("reply_id"), raw.alias("raw"))


@register("S10_grounded_reply_parse", _GROUNDED + "," + _items_sql("g") + """
SELECT reply_id, CAST(item_no AS INT) AS item_no, json_extract_string(item, '$.question') AS question,
       json_extract_string(item, '$.correct_answer') AS correct_answer,
       COALESCE(json_extract_string(item, '$.question_type'), 'SIMPLE') AS question_type,
       COALESCE(json_extract_string(item, '$.difficulty'), 'MEDIUM') AS difficulty,
       'rag,' || lower(COALESCE(json_extract_string(item, '$.question_type'), 'SIMPLE')) || ',grounded' AS tags
FROM items
WHERE json_type(item) = 'OBJECT' AND json_type(item, '$.question') = 'VARCHAR' AND json_type(item, '$.correct_answer') = 'VARCHAR'
  AND COALESCE(json_extract_string(item, '$.question_type'), 'SIMPLE') IN ('SIMPLE','COMPLEX','DISTRACTING','SITUATIONAL','DOUBLE','CONVERSATIONAL')
  AND COALESCE(json_extract_string(item, '$.difficulty'), 'MEDIUM') IN ('EASY','MEDIUM','HARD','ADVERSARIAL')
""")
def s10_grounded(t):
    """S-10: grounded-QA replies -> question rows with tags rag,<type>,grounded."""
    p = RO.parse_grounded(_grounded_replies(t), ["reply_id"])
    return p.select("reply_id", F.col("item_no").cast("int").alias("item_no"), "question", "correct_answer",
                    "question_type", "difficulty", F.array_join("tags", ",").alias("tags"))


@register("S11_cluster_label_parse", """
WITH g AS (SELECT o_orderkey AS reply_id, CAST(o_orderkey % 9 AS BIGINT) AS cluster, CASE o_orderkey % 3
  WHEN 0 THEN '{"root_cause": "missing policy", "evidence": "ev", "immediate_fix": "add rule", "cluster_label": "refund gaps"}'
  WHEN 1 THEN '```json' || chr(10) || '{"evidence": "only evidence"}' || chr(10) || '```'
  ELSE 'timeout' END AS raw FROM orders),
s AS (SELECT *, CASE WHEN starts_with(trim(raw), '```') THEN trim(regexp_replace(split_part(trim(raw), '```', 2), '^json', '')) ELSE trim(raw) END AS js0 FROM g),
v AS (SELECT *, CASE WHEN json_valid(js0) AND json_type(js0) = 'OBJECT' THEN js0 END AS js FROM s)
SELECT reply_id, cluster,
       CASE WHEN js IS NULL THEN 'Analysis failed — review manually' ELSE COALESCE(json_extract_string(js, '$.root_cause'), 'Unknown root cause') END AS root_cause,
       CASE WHEN js IS NULL THEN '' ELSE COALESCE(json_extract_string(js, '$.evidence'), '') END AS evidence,
       CASE WHEN js IS NULL THEN 'Manual review required' ELSE COALESCE(json_extract_string(js, '$.immediate_fix'), 'Review manually') END AS immediate_fix,
       COALESCE(json_extract_string(js, '$.cluster_label'), 'cluster_' || CAST(cluster AS VARCHAR)) AS cluster_label
FROM v
""")
def s11_cluster_label(t):
    """S-11: cluster-label replies -> root cause / evidence / fix / label with defaults."""
    o = t.orders
    k = F.col("o_orderkey")
    raw = (F.when(k % 3 == 0, F.lit('{"root_cause": "missing policy", "evidence": "ev", "immediate_fix": "add rule", '
                                    '"cluster_label": "refund gaps"}'))
            .when(k % 3 == 1, F.lit('```json\n{"evidence": "only evidence"}\n```'))
            .otherwise(F.lit("timeout")))
    r = o.select(k.alias("reply_id"), (k % 9).cast("bigint").alias("cluster"), raw.alias("raw"))
    return RO.parse_cluster_label(r, ["reply_id"])
