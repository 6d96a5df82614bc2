"""Registered queries: learning state (P-19, J-01, J-04, A-19..A-23, W-07, L-01..L-05, SRC-12/13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analyze as AN
from ..operators import learn as L
from ..sources import fixtures as FX
from .registry import register

_SYS_SQL = "substr(sha256(concat_ws('|', system_type, company, '', '', '', '')), 1, 16)"

_JOINED = f"""
WITH sc AS (
  SELECT *, {_SYS_SQL} AS system_hash,
         CASE WHEN tag_list = '' THEN [] ELSE string_split(tag_list, '|') END AS tags
  FROM scenarios),
j AS (
  SELECT r.result_id, r.result_id AS seq, r.scenario_id, r.run_id, r.passed, r.failure_type, r.created_at,
         'answer ' || CAST(r.result_id % 300 AS VARCHAR) AS actual_response,
         sc.system_hash, sc.system_type, sc.input, sc.expected_behavior, sc.difficulty, sc.tags, sc.company
  FROM results r JOIN sc ON sc.scenario_id = r.scenario_id)
"""


#: Results before this id are the earlier fold of the queries that merge into a state.
_HALF = 7_500


def _scenarios(t):
    s = FX.scenarios(t)
    return s.select("*", L.system_hash("system_type", "company").alias("system_hash"),
                    F.when(F.col("tag_list") == "", F.array().cast("array<string>"))
                     .otherwise(F.split("tag_list", r"\|")).alias("tags"))


def _joined(t):
    res = FX.results(t).withColumn("seq", F.col("result_id")).drop("company").withColumn(
        "actual_response", F.concat(F.lit("answer "), (F.col("result_id") % 300).cast("string")))
    return L.join_results_scenarios(res, _scenarios(t))


@register("P19_system_hash", f"""
SELECT DISTINCT company, system_type, {_SYS_SQL} AS system_hash FROM scenarios
""")
def p19_system_hash(t):
    """P-19: 16-hex fingerprint of each (company, system type) configuration."""
    s = FX.scenarios(t).select("company", "system_type").distinct()
    return s.select("company", "system_type", L.system_hash("system_type", "company").alias("system_hash"))


@register("J01_results_with_scenarios", _JOINED + """
SELECT result_id, scenario_id, run_id, system_type, difficulty, input, passed FROM j
""")
def j01_join(t):
    """J-01: results joined to their scenarios (inner)."""
    return _joined(t).select("result_id", "scenario_id", "run_id", "system_type", "difficulty", "input", "passed")


_A20 = _JOINED + """,
e AS (
  SELECT system_hash, system_type, CASE WHEN len(tags) > 0 THEN array_to_string(list_sort(tags), '|') ELSE difficulty END AS pattern,
         NOT passed AS found_failure, seq FROM j),
m AS (
  SELECT system_hash, pattern, system_type, COUNT(*) AS times_used,
         CAST(SUM(CASE WHEN found_failure THEN 1 ELSE 0 END) AS BIGINT) AS failures, MIN(seq) AS first_seq
  FROM e GROUP BY ALL)
"""


@register("A20_episodic_memory", _A20 + """
SELECT system_hash, pattern, system_type, times_used, failures, failures / CAST(times_used AS DOUBLE) AS failure_rate FROM m
""")
def a20_episodic_memory(t):
    """A-20/A-21: failure rate per (system, tag pattern) over all runs."""
    ev = L.effectiveness_events(_joined(t))
    return L.episodic_memory(ev).drop("first_seq")


@register("A20_memory_merge", _A20 + """
SELECT system_hash, pattern, system_type, times_used, failures, failures / CAST(times_used AS DOUBLE) AS failure_rate FROM m
""")
def a20_memory_merge(t):
    """A-20/A-21: two folds - the events of the later results merged into the memory of the earlier ones."""
    ev = L.effectiveness_events(_joined(t))
    cut = F.col("seq") < F.lit(_HALF)
    state = L.episodic_memory(ev.where(cut)).drop("failure_rate")
    return L.episodic_memory(ev.where(~cut), state=state).drop("first_seq")


@register("A19_high_value_patterns", _A20 + """
SELECT system_hash, pattern, failure_rate, CAST(rank AS INT) AS rank FROM (
  SELECT system_hash, pattern, failures / CAST(times_used AS DOUBLE) AS failure_rate,
         ROW_NUMBER() OVER (PARTITION BY system_hash ORDER BY failures / CAST(times_used AS DOUBLE) DESC, first_seq) AS rank
  FROM m WHERE failures >= times_used * 0.3) x WHERE rank <= 10
""")
def a19_high_value(t):
    """A-19: patterns that fail >= 30 % of the time, best 10 per system."""
    mem = L.episodic_memory(L.effectiveness_events(_joined(t)))
    return L.high_value_patterns(mem).select("system_hash", "pattern", "failure_rate",
                                             F.col("rank").cast("int").alias("rank"))


_REG = _JOINED + """,
f AS (SELECT * FROM j WHERE NOT passed AND failure_type IS NOT NULL),
firsts AS (SELECT system_hash, input, arg_min({'e': expected_behavior, 'ft': failure_type, 'st': system_type, 'd': created_at, 's': seq}, seq) AS r
           FROM f GROUP BY system_hash, input)
"""


@register("L01_regression_library", _REG + """
SELECT system_hash, input, r.e AS expected_behavior, 'HARD' AS difficulty,
       array_to_string(['regression', 'regression_' || substr(system_hash, 1, 8), lower(r.ft), 'run_' || strftime(r.d, '%Y%m%d')], ',') AS tags,
       r.st AS system_type, r.s AS seq
FROM firsts
""")
def l01_regressions(t):
    """L-01 + J-04: failing inputs not yet in the library become HARD regression scenarios."""
    return L.regression_candidates(_joined(t)).withColumn("tags", F.array_join("tags", ","))


@register("L02_load_regressions", _REG + """
SELECT system_hash, input, r.e AS expected_behavior, 'HARD' AS difficulty, r.st AS system_type, r.s AS seq FROM firsts
""")
def l02_load_regressions(t):
    """L-02: regression scenarios of every system that has scenarios."""
    return L.load_regressions(L.regression_candidates(_joined(t)), _scenarios(t)).drop("tags")


@register("L01_regression_merge", _REG + """
SELECT system_hash, input, r.s AS seq FROM firsts
""")
def l01_regression_merge(t):
    """J-04: two folds - the failures of the later results join a library that already holds the earlier ones."""
    joined = _joined(t)
    cut = F.col("seq") < F.lit(_HALF)
    library = L.regression_candidates(joined.where(cut))
    return library.unionByName(L.regression_candidates(joined.where(~cut), library=library)).select("system_hash", "input", "seq")


@register("L03_finetuning_pairs", _JOINED + """
SELECT system_hash, scenario_id, input, actual_response AS wrong_output, expected_behavior AS correct_output, failure_type, difficulty
FROM j WHERE NOT passed AND failure_type IS NOT NULL
""")
def l03_finetuning_pairs(t):
    """L-03: one (input, wrong output, correct output) row per failed typed result, no dedupe."""
    return L.finetuning_pairs(_joined(t)).select("system_hash", "scenario_id", "input", "wrong_output", "correct_output",
                                                 "failure_type", "difficulty")


@register("SRC12_finetune_jsonl", _JOINED + """
SELECT scenario_id, CAST(json_object('messages', [json_object('role', 'user', 'content', input),
                                                  json_object('role', 'assistant', 'content', expected_behavior)],
                                     'metadata', json_object('failure_type', failure_type, 'difficulty', difficulty)) AS VARCHAR) AS value
FROM j WHERE NOT passed AND failure_type IS NOT NULL
""")
def src12_finetune_jsonl(t):
    """SRC-12: fine-tuning export lines ({messages:[user, assistant], metadata})."""
    from ..sources.export import finetune_jsonl_lines
    return finetune_jsonl_lines(L.finetuning_pairs(_joined(t)))


def _patterns(t):
    res = FX.results(t).withColumn("seq", F.col("result_id"))
    failed = res.where(~F.col("passed"))
    return AN.patterns_by_type(failed, carry=["company"])


@register("A05_patterns_by_type", """
WITH f AS (SELECT * FROM results WHERE NOT passed),
tot AS (SELECT run_id, COUNT(*) AS total FROM f GROUP BY run_id),
g AS (SELECT run_id, COALESCE(failure_type, 'UNKNOWN') AS type_key, COUNT(*) AS scenario_count, MIN(result_id) AS first
      FROM f GROUP BY ALL)
SELECT g.run_id, type_key,
       CASE WHEN type_key IN ('HALLUCINATION','POLICY_VIOLATION','INCOMPLETE','WRONG_ANSWER','CONTEXT_LOSS','ESCALATION_FAILURE') THEN type_key ELSE 'WRONG_ANSWER' END AS failure_type,
       scenario_count,
       CASE WHEN type_key IN ('POLICY_VIOLATION','ESCALATION_FAILURE','HALLUCINATION') THEN 'HIGH'
            WHEN type_key = 'CONTEXT_LOSS' THEN 'LOW' ELSE 'MEDIUM' END AS priority,
       CAST(ROW_NUMBER() OVER (PARTITION BY g.run_id ORDER BY scenario_count DESC, first) AS INT) AS pattern_rank
FROM g JOIN tot ON tot.run_id = g.run_id
""")
def a05_patterns_by_type(t):
    """A-05/K-01: one pattern per failure type of each run (clustering skipped), by size."""
    return _patterns(t).select("run_id", "type_key", "failure_type", "scenario_count", "priority",
                               F.col("pattern_rank").cast("int").alias("pattern_rank"))


@register("A23_strategy_weights", """
WITH f AS (SELECT * FROM results WHERE NOT passed),
p AS (SELECT DISTINCT company, run_id,
             CASE WHEN COALESCE(failure_type, 'UNKNOWN') IN ('HALLUCINATION','POLICY_VIOLATION','INCOMPLETE','WRONG_ANSWER','CONTEXT_LOSS','ESCALATION_FAILURE')
                  THEN failure_type ELSE 'WRONG_ANSWER' END AS failure_type, COALESCE(failure_type, 'UNKNOWN') AS k FROM f),
w AS (SELECT company AS system_hash, failure_type, LEAST(CAST(3.0 AS DOUBLE), 1.0 + 0.5 * COUNT(*)) AS weight
      FROM p GROUP BY ALL),
m AS (SELECT company AS system_hash, COUNT(*) AS run_count, arg_max(pass_rate, {'c': created_at, 'r': run_id}) AS last_pass_rate
      FROM runs GROUP BY company)
SELECT w.system_hash, failure_type, CAST(weight AS DOUBLE) AS weight, run_count, last_pass_rate
FROM w LEFT JOIN m ON m.system_hash = w.system_hash
""")
def a23_strategy_weights(t):
    """A-23: failure-type weights after folding every run's patterns (system = company)."""
    pats = _patterns(t).withColumnRenamed("company", "system_hash")
    runs = FX.runs(t).withColumnRenamed("company", "system_hash")
    return L.strategy_weights(pats, runs)


_STATE = """
WITH f AS (SELECT * FROM results WHERE NOT passed),
g AS (SELECT company, run_id, COALESCE(failure_type, 'UNKNOWN') AS type_key, COUNT(*) AS n, MIN(result_id) AS first FROM f GROUP BY ALL),
p AS (SELECT *, CASE WHEN type_key IN ('HALLUCINATION','POLICY_VIOLATION','INCOMPLETE','WRONG_ANSWER','CONTEXT_LOSS','ESCALATION_FAILURE')
                     THEN type_key ELSE 'WRONG_ANSWER' END AS failure_type,
             ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY n DESC, first) AS rk FROM g),
w AS (SELECT company, failure_type, LEAST(CAST(3.0 AS DOUBLE), CAST(1.0 AS DOUBLE) + 0.5 * COUNT(*)) AS weight FROM p GROUP BY ALL),
ws AS (SELECT company, string_agg(failure_type || '=' || CAST(CAST(weight AS DOUBLE) AS VARCHAR), ',' ORDER BY failure_type) AS weights FROM w GROUP BY company),
lr AS (SELECT company, COUNT(*) AS run_count, arg_max(pass_rate, {'c': created_at, 'r': run_id}) AS last_pass_rate,
              arg_max(run_id, {'c': created_at, 'r': run_id}) AS run_id FROM runs GROUP BY company),
fp AS (SELECT p.company, string_agg(lower(type_key) || ':' || failure_type || ':' || CAST(n AS VARCHAR), '|' ORDER BY rk) AS found
       FROM p JOIN lr ON lr.run_id = p.run_id WHERE rk <= 10 GROUP BY p.company)
"""


def _strategy(t):
    """Strategy state of every system (system = company), folded in two steps."""
    pats = _patterns(t).select(
        F.col("company").alias("system_hash"), "run_id", "pattern_rank", F.lower("type_key").alias("cluster_label"),
        F.lit("").alias("root_cause"), "failure_type", "scenario_count")
    runs = FX.runs(t).withColumnRenamed("company", "system_hash")
    early = F.substring("run_id", -6, 4).cast("int") < 1995  # run ids end in the year and quarter
    state = L.strategy_state(pats.where(early), runs.where(early))
    return L.strategy_state(pats.where(~early), runs.where(~early), state=state)


def _weights_text(c):
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


@register("A23_strategy_state", _STATE + """
SELECT lr.company AS system_hash, weights, last_pass_rate, COALESCE(found, '') AS found_patterns, run_count
FROM lr LEFT JOIN ws ON ws.company = lr.company LEFT JOIN fp ON fp.company = lr.company
""")
def a23_strategy_state(t):
    """A-23: strategy state after folding the runs in two steps: weights, last pass rate, patterns of the latest run."""
    found = F.array_join(F.transform("found_patterns", lambda p: F.concat_ws(
        ":", p["cluster_label"], p["failure_type"], p["count"].cast("string"))), "|")
    return _strategy(t).select("system_hash", _weights_text(F.col("failure_weights")).alias("weights"), "last_pass_rate",
                               found.alias("found_patterns"), "run_count")


@register("L05_generation_strategy", _STATE + """
SELECT lr.company AS system_hash, weights, run_count FROM lr LEFT JOIN ws ON ws.company = lr.company
""")
def l05_strategy(t):
    """L-05: read back the strategy of every system with runs."""
    wanted = FX.runs(t).select(F.col("company").alias("system_hash"))
    return L.generation_strategy(_strategy(t), wanted).select("system_hash", _weights_text(F.col("failure_weights")).alias("weights"), "run_count")


_PERSONA = """
WITH u AS (
  SELECT persona, system_type, ord,
         ROW_NUMBER() OVER (PARTITION BY persona, system_type ORDER BY ord) AS times,
         SUM(CASE WHEN found_failure THEN 1 ELSE 0 END) OVER (PARTITION BY persona, system_type ORDER BY ord
                                                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fails
  FROM persona_use),
tr AS (
  SELECT *, CASE WHEN times = 1 THEN NULL WHEN 5 * fails >= 2 * times THEN 'high_value'
                 WHEN 20 * fails <= times AND times >= 5 THEN 'retired' END AS transition FROM u)
"""


@register("A22_persona_effectiveness", _PERSONA + """
SELECT persona, system_type, MAX(times) AS times_used, CAST(MAX(fails) AS BIGINT) AS failures,
       MAX(fails) / CAST(MAX(times) AS DOUBLE) AS failure_discovery_rate,
       COALESCE(arg_max(transition, ord) FILTER (WHERE transition IS NOT NULL), 'active') AS status
FROM tr GROUP BY persona, system_type
""")
def a22_persona_effectiveness(t):
    """A-22: sticky persona status and discovery rate per (persona, system type)."""
    return L.persona_effectiveness(FX.persona_use(t))


@register("W07_persona_running_rate", """
SELECT persona, system_type, ord,
       ROW_NUMBER() OVER (PARTITION BY persona, system_type ORDER BY ord) AS times_used,
       AVG(CASE WHEN found_failure THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY persona, system_type ORDER BY ord
                                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_rate
FROM persona_use
""")
def w07_running_rate(t):
    """W-07: running discovery rate after each use of a persona."""
    return L.persona_running_rate(FX.persona_use(t))
