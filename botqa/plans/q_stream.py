"""Registered queries: Structured Streaming jobs (ST-01..ST-05).

Each callable runs its streaming job over the input files (``availableNow``
trigger) into a folder under the shared checkpoint folder and returns the
sink's view; the SQL oracle is the batch definition of the same state.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures as FX
from ..streaming import jobs as SJ
from ..streaming.sources import StreamTables
from . import q_learn as QL
from .registry import QUERIES, register


def _stream_results(t):
    st = StreamTables(t.spark, t.sf_dir)
    return FX.results(st).withColumn("seq", F.col("result_id")).drop("company")


@register("ST01_episodic_memory_stream", QUERIES["A20_episodic_memory"].sql)
def st01(t):
    """ST-01: streaming episodic memory (per-batch increments, summed state)."""
    return SJ.episodic_memory_stream(_stream_results(t), QL._scenarios(t))


@register("ST02_regression_library_stream", QUERIES["L01_regression_library"].sql)
def st02(t):
    """ST-02: streaming regression library (first failing input per system, anti-joined to the library)."""
    lib = SJ.regression_library_stream(_stream_results(t), QL._scenarios(t))
    return lib.drop("batch_id").withColumn("tags", F.array_join("tags", ","))


@register("ST03_live_run_counters", """
SELECT run_id, COUNT(*) AS total, CAST(SUM(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS passed_count,
       CAST(SUM(CASE WHEN NOT passed AND failure_type IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS typed_failures
FROM results GROUP BY run_id
""")
def st03(t):
    """ST-03: live per-run counters from a streaming aggregate (update mode)."""
    return SJ.live_run_counters_stream(FX.results(StreamTables(t.spark, t.sf_dir)))


@register("ST04_persona_status_stream", QUERIES["A22_persona_effectiveness"].sql.replace(
    "MAX(fails) / CAST(MAX(times) AS DOUBLE) AS failure_discovery_rate,", ""))
def st04(t):
    """ST-04: sticky persona status, each micro-batch on top of the state before it."""
    return SJ.persona_status_stream(FX.persona_use(StreamTables(t.spark, t.sf_dir)))


_ST05 = """
WITH cl AS (SELECT scenario_id FROM verdicts GROUP BY scenario_id
            HAVING COUNT(DISTINCT slot) = 3 OR MAX(created_at) + INTERVAL 1 DAY < (SELECT MAX(created_at) FROM verdicts) - INTERVAL 1 DAY),
vw AS (SELECT v.* FROM verdicts v JOIN cl ON cl.scenario_id = v.scenario_id),
agg AS (SELECT scenario_id, COUNT(*) AS total, SUM(CASE WHEN passed THEN 1 ELSE 0 END) AS p
        FROM vw GROUP BY ALL),
ft AS (SELECT scenario_id, failure_type,
              ROW_NUMBER() OVER (PARTITION BY scenario_id ORDER BY COUNT(*) DESC, MIN(slot)) AS rn
       FROM vw WHERE NOT passed AND failure_type IS NOT NULL GROUP BY scenario_id, failure_type),
b AS (SELECT a.scenario_id, a.total, a.p, a.total - a.p AS f, ft.failure_type AS top
      FROM agg a LEFT JOIN ft ON ft.scenario_id = a.scenario_id AND ft.rn = 1)
SELECT scenario_id,
       CASE WHEN p = f THEN FALSE ELSE p > f END AS passed,
       CAST(CASE WHEN p = f THEN 0.33 WHEN GREATEST(p, f) = total THEN 0.95
                 WHEN GREATEST(p, f) = total - 1 THEN 0.75 ELSE 0.33 END AS DOUBLE) AS confidence,
       CASE WHEN p = f THEN 'tie' WHEN GREATEST(p, f) = total THEN 'unanimous'
            WHEN GREATEST(p, f) = total - 1 THEN 'majority' ELSE 'minority' END AS agreement_level,
       (p = f OR (GREATEST(p, f) <> total AND GREATEST(p, f) <> total - 1)) AS requires_human_review,
       CASE WHEN p = f THEN 'Judges tied — equal pass and fail votes'
            WHEN GREATEST(p, f) <> total AND GREATEST(p, f) <> total - 1 THEN 'Only minority agreement among judges'
            ELSE '' END AS human_review_reason,
       CASE WHEN f > p THEN top END AS failure_type,
       CAST(p AS BIGINT) AS pass_votes, CAST(f AS BIGINT) AS fail_votes
FROM b
"""


@register("ST05_panel_close_stream", _ST05)
def st05(t):
    """ST-05: panel verdict per scenario, once all slots have voted or the watermark is a day past its last vote."""
    return SJ.panel_close_stream(FX.verdicts(StreamTables(t.spark, t.sf_dir))).drop("batch_id")
