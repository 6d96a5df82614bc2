"""Model replies -> rows (S-08..S-12).

A reply is a text column; parsing is ``from_json`` + ``get_json_object`` and
an ``explode`` of the array items, all JVM-side.  Invalid items are skipped
exactly where the reference's per-item ``try`` skips them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.replies import is_json_object, json_str, reply_items
from ..functions.text import strip_fence

RAG_QUESTION_TYPES = ["SIMPLE", "COMPLEX", "DISTRACTING", "SITUATIONAL", "DOUBLE", "CONVERSATIONAL"]


def _items(replies: DataFrame, keys: list[str], raw_col: str) -> DataFrame:
    return replies.select(*keys, F.posexplode(reply_items(F.col(raw_col))).alias("item_no", "item"))


def parse_scenarios(replies: DataFrame, keys: list[str], raw_col: str = "raw") -> DataFrame:
    """S-08: scenario-array reply -> scenario rows.  An item needs string
    ``input`` and ``expected_behavior`` and a valid difficulty (default
    MEDIUM); tags default to []."""
    it = _items(replies, keys, raw_col)
    diff = F.coalesce(F.get_json_object("item", "$.difficulty"), F.lit("MEDIUM"))
    has_diff = F.array_contains(F.json_object_keys("item"), F.lit("difficulty"))
    diff_ok = ~has_diff | (json_str("item", "difficulty").isin(S.DIFFICULTIES))
    ok = (is_json_object("item") & json_str("item", "input").isNotNull()
          & json_str("item", "expected_behavior").isNotNull() & diff_ok)
    tags = F.coalesce(F.from_json(F.get_json_object("item", "$.tags"), "array<string>"),
                      F.array().cast("array<string>"))
    return it.where(ok).select(*keys, "item_no", json_str("item", "input").alias("input"),
                               json_str("item", "expected_behavior").alias("expected_behavior"),
                               diff.alias("difficulty"), tags.alias("tags"),
                               F.get_json_object("item", "$.persona_used").alias("persona_used"))


def parse_critic_scores(replies: DataFrame, keys: list[str], raw_col: str = "raw",
                        expected_col: str | None = None) -> DataFrame:
    """S-09: critic reply -> (slot, average, feedback).  A reply that does not
    parse, or whose length differs from the batch (``expected_col``), scores
    every slot 5.0 with empty feedback (P-21 approves them all)."""
    arr = reply_items(F.col(raw_col))
    n = F.size(arr)
    bad = arr.isNull() if expected_col is None else (arr.isNull() | (n != F.col(expected_col)))
    good = replies.where(~bad).select(*keys, F.posexplode(arr).alias("slot", "item")).select(
        *keys, "slot", F.coalesce(F.get_json_object("item", "$.average").cast("double"), F.lit(0.0)).alias("average"),
        F.coalesce(F.get_json_object("item", "$.feedback"), F.lit("")).alias("feedback"))
    if expected_col is None:
        return good
    filled = replies.where(bad).select(*keys, F.explode(F.sequence(F.lit(0), F.col(expected_col) - 1)).alias("slot")) \
        .select(*keys, "slot", F.lit(5.0).alias("average"), F.lit("").alias("feedback"))
    return good.unionByName(filled)


def parse_grounded(replies: DataFrame, keys: list[str], raw_col: str = "raw") -> DataFrame:
    """S-10: grounded-QA reply -> rows (question, answer, chunk, type,
    difficulty); tags ``rag, <type lower>, grounded``.  question_type must be
    one of the (upper-case) enum values, default SIMPLE."""
    it = _items(replies, keys, raw_col)
    has_qt = F.array_contains(F.json_object_keys("item"), F.lit("question_type"))
    qt = F.when(has_qt, json_str("item", "question_type")).otherwise(F.lit("SIMPLE"))
    has_d = F.array_contains(F.json_object_keys("item"), F.lit("difficulty"))
    diff = F.when(has_d, json_str("item", "difficulty")).otherwise(F.lit("MEDIUM"))
    ok = (is_json_object("item") & json_str("item", "question").isNotNull()
          & json_str("item", "correct_answer").isNotNull() & qt.isin(RAG_QUESTION_TYPES)
          & diff.isin(S.DIFFICULTIES))
    ans = json_str("item", "correct_answer")
    return it.where(ok).select(
        *keys, "item_no", json_str("item", "question").alias("question"), ans.alias("correct_answer"),
        F.concat(F.lit("Answer correctly based on document. Correct answer: "), ans).alias("expected_behavior"),
        F.coalesce(json_str("item", "source_chunk"), F.lit("")).alias("source_chunk"),
        qt.alias("question_type"), diff.alias("difficulty"),
        F.array(F.lit("rag"), F.lower(qt), F.lit("grounded")).alias("tags"))


def parse_cluster_label(replies: DataFrame, keys: list[str], raw_col: str = "raw",
                        cluster_col: str = "cluster") -> DataFrame:
    """S-11: cluster-label reply -> root cause, evidence, fix, label with
    defaults; an unparsable reply gives the fixed failure texts."""
    js = strip_fence(F.col(raw_col))
    ok = is_json_object(js)
    label_default = F.concat(F.lit("cluster_"), F.col(cluster_col).cast("string"))

    def pick(key, default, fail):
        return F.when(ok, F.coalesce(F.get_json_object(js, f"$.{key}"), default)).otherwise(fail)

    return replies.select(
        *keys, cluster_col,
        pick("root_cause", F.lit("Unknown root cause"), F.lit("Analysis failed — review manually")).alias("root_cause"),
        pick("evidence", F.lit(""), F.lit("")).alias("evidence"),
        pick("immediate_fix", F.lit("Review manually"), F.lit("Manual review required")).alias("immediate_fix"),
        pick("cluster_label", label_default, label_default).alias("cluster_label"))
