"""Registry of named queries: each is a Spark plan over the input tables plus,
where the semantics fit in SQL, an equivalent DuckDB statement used as an
independent oracle.

The oracle statements re-derive the entity tables from the raw input tables
with the SQL of FIXTURES.md (``FIXTURE_SQL``).  Both sides share fixed values,
prompt templates and the rounding formula.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables


@dataclass
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    doc: str


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


# Entity tables as SQL over the raw input tables (runs unchanged in DuckDB).
FIXTURE_SQL = {
    "conv": """
SELECT conv_id, turn, role, text AS content,
       CASE WHEN conv_id % 3 = 0 THEN 'good: resolved'
            WHEN conv_id % 3 = 1 THEN 'bad answer' END AS outcome,
       CONCAT('co_', CAST(conv_id % 7 AS VARCHAR)) AS company
FROM conversations""",
    "responses": """
SELECT scenario_id, company, input, actual_response, latency_ms FROM (
  SELECT conv_id * 1000000 + turn AS scenario_id,
         CONCAT('co_', CAST(conv_id % 7 AS VARCHAR)) AS company,
         role, text AS input,
         LEAD(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
         LEAD(text) OVER (PARTITION BY conv_id ORDER BY turn) AS actual_response,
         CAST(100 + (conv_id * 37 + turn * 11) % 900 AS DOUBLE) AS latency_ms
  FROM conversations) t
WHERE role = 'user' AND (next_role = 'assistant' OR next_role IS NULL)""",
    "verdicts": """
SELECT CAST(FLOOR(event_id / 3) AS BIGINT) AS scenario_id,
       CAST(event_id % 3 AS INT) AS slot,
       CONCAT('judge_', CAST(event_id % 3 AS VARCHAR)) AS judge_model,
       event_type IN ('view', 'click') AS passed,
       CASE event_type WHEN 'signup' THEN 'WRONG_ANSWER' WHEN 'purchase' THEN 'POLICY_VIOLATION' END AS failure_type,
       value / CAST(500 AS DOUBLE) AS confidence, ts AS created_at
FROM events WHERE event_type <> 'error'""",
    "panel_scenarios": """
SELECT DISTINCT CAST(FLOOR(event_id / 3) AS BIGINT) AS scenario_id FROM events""",
    "raw_replies": """
SELECT event_id AS reply_id,
       CASE event_id % 5
         WHEN 0 THEN CONCAT('{"passed": ', body, ', "confidence": 0.5, "reasoning": "ok"}')
         WHEN 1 THEN CONCAT('```json', CHR(10), '{"passed": ', body, ', "failure_type": "INCOMPLETE", "confidence": 0.25}', CHR(10), '```')
         WHEN 2 THEN CONCAT('{"passed": ', body, '}')
         WHEN 3 THEN 'I cannot answer in JSON'
         ELSE CONCAT('```', CHR(10), '{"passed": ', body, ', "failure_type": "NOT_A_TYPE"}', CHR(10), '```') END AS raw
FROM (SELECT event_id, CASE WHEN value < 250 THEN 'true' ELSE 'false' END AS body FROM events) e""",
    "scenarios": """
SELECT o_orderkey AS scenario_id,
       CONCAT('co_', CAST(o_custkey % 7 AS VARCHAR)) AS company,
       CASE o_orderkey % 3 WHEN 0 THEN 'CUSTOMER_SUPPORT' WHEN 1 THEN 'RAG' ELSE 'MULTI_AGENT' END AS system_type,
       CONCAT('input ', CAST(o_orderkey % 500 AS VARCHAR)) AS input,
       CONCAT('expected ', CAST(o_orderkey % 500 AS VARCHAR)) AS expected_behavior,
       CASE o_orderkey % 4 WHEN 0 THEN 'EASY' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HARD' ELSE 'ADVERSARIAL' END AS difficulty,
       CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CONCAT('tag_', CAST(o_orderkey % 3 AS VARCHAR), '|', 'pri_', SUBSTRING(o_orderpriority, 1, 1)) END AS tag_list,
       o_orderdate AS created_at
FROM orders""",
    "results": """
SELECT o_orderkey AS result_id, o_orderkey AS scenario_id,
       CONCAT('co_', CAST(o_custkey % 7 AS VARCHAR)) AS company,
       CONCAT('co_', CAST(o_custkey % 7 AS VARCHAR), '_', CAST(YEAR(o_orderdate) AS VARCHAR), 'q', CAST(QUARTER(o_orderdate) AS VARCHAR)) AS run_id,
       o_orderstatus <> 'P' OR (o_orderkey % 7) < (o_custkey % 7) AS passed,
       CASE WHEN o_orderstatus <> 'P' OR (o_orderkey % 7) < (o_custkey % 7) THEN NULL
            WHEN o_orderpriority = '1-URGENT' THEN 'POLICY_VIOLATION'
            WHEN o_orderpriority = '2-HIGH' THEN 'HALLUCINATION'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'WRONG_ANSWER'
            WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'ESCALATION_FAILURE' END AS failure_type,
       CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0.95 WHEN o_orderkey % 4 = 1 THEN 0.33 ELSE 0.75 END AS DOUBLE) AS confidence_score,
       o_totalprice / CAST(100 AS DOUBLE) AS latency_ms,
       CAST(FLOOR(o_totalprice / 100) AS BIGINT) AS tokens,
       o_orderdate AS created_at
FROM orders""",
    "runs": """
SELECT run_id, company, MIN(created_at) AS created_at,
       CASE WHEN MIN(result_id) % 11 = 0 THEN 'failed' WHEN MIN(result_id) % 13 = 0 THEN 'running' ELSE 'completed' END AS status,
       AVG(CAST(CASE WHEN passed THEN 1 ELSE 0 END AS DOUBLE)) AS pass_rate,
       COUNT(*) AS total_scenarios,
       CAST(SUM(CASE WHEN passed THEN 0 ELSE 1 END) AS BIGINT) AS total_failures,
       ROUND(CAST(SUM(tokens) AS DOUBLE) / 1000 * CAST(0.003 AS DOUBLE), 4) AS run_cost_usd
FROM results GROUP BY run_id, company""",
    "persona_use": """
SELECT event_id AS ord, CONCAT('p_', CAST(user_id % 20 AS VARCHAR)) AS persona,
       CASE event_id % 3 WHEN 0 THEN 'CUSTOMER_SUPPORT' WHEN 1 THEN 'RAG' ELSE 'MULTI_AGENT' END AS system_type,
       (event_id * 7) % 100 < (user_id % 20) * 4 AS found_failure
FROM events""",
    "human_labels": """
SELECT l.doc_id AS result_id, d.source AS domain, l.quality = 1 AS human_passed,
       CASE WHEN l.doc_id % 5 = 0 THEN l.quality = 0 ELSE l.quality = 1 END AS judge_passed
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "kb_docs": """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS content, source,
       CASE doc_id % 4 WHEN 0 THEN 'UPLOADED' WHEN 1 THEN 'SCRAPED_COMPANY_SITE' WHEN 2 THEN 'SCRAPED_EXTERNAL' ELSE 'SYNTHETIC_CHALLENGING' END AS source_type,
       doc_id % 4 = 3 AS is_synthetic
FROM documents""",
    "fail_vecs": """
SELECT vec_id AS result_id, CONCAT('r_', CAST(vec_id % 5 AS VARCHAR)) AS run_id, embedding, label
FROM embeddings""",
}

# fixtures that read other fixtures
_FIXTURE_DEPS = {"runs": ["results"]}


def with_fixtures(body: str) -> str:
    """Prefix ``body`` with the CTEs of every fixture it mentions."""
    used: list[str] = []

    def need(name: str):
        for d in _FIXTURE_DEPS.get(name, []):
            need(d)
        if name not in used:
            used.append(name)

    for name in FIXTURE_SQL:
        if re.search(rf"\b{name}\b", body):
            need(name)
    if not used:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in used)
    b = body.strip()
    if re.match(r"(?i)^with\s", b):
        return f"WITH {ctes},\n{b[5:]}"
    return f"WITH {ctes}\n{b}"


def run_query(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return QUERIES[name].build(Tables(spark, sf_dir))
