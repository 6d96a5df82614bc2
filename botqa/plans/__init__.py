"""Registered queries (one per operator of the inventory) and their SQL oracles."""

from . import q_judging, q_insights, q_runs, q_learn, q_fix, q_report, q_plan, q_kb, q_cluster, q_parse, q_stream, q_rubric, q_prompt, q_flow, q_more, q_generator  # noqa: F401,E501  (register queries)
from .registry import QUERIES, run_query, with_fixtures  # noqa: F401
