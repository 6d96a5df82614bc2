"""Chat formatting of reply trees.

A message names the message that it answers.  Iterated self-joins double each
message's pointer towards its root, which gives depth and path score of every
root-to-leaf path in as many rounds as the depth has binary digits; the best
leaves of each tree are ranked by mean score, and the same pointers, from the
longest jump to the shortest, list the messages of the chosen paths.  Each chosen
path becomes one conversation.  All steps are DataFrame expressions keyed by
message, so a large tree is spread over all tasks until its path is put together.

Template: ``<|im_start|>role, line break, text, <|im_end|>, line break`` per turn.  Control
strings inside a text (those of this template and of other common ones) are
broken by a backslash after their first character, and a backslash is doubled;
``unescape`` undoes it exactly.  Roles are URL-encoded.  ``loss_spans`` marks the
texts of the trained roles as code points of the formatted string.

Edges: null text or role counts as empty; a message whose parent is missing is a
root; equal scores go to the deeper leaf, then to the smaller message number;
repeated messages need numbers of their own (``as_chains`` gives them); a cycle of
replies raises an error; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, with_row_numbers

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Starts of control strings: <|...  <s>  </s>  <<SYS>>  <</SYS>>  [INST]  [/INST], and the backslash itself.
_CONTROL = r"\\|<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"
_ESCAPED = r"([\\<\[])\\"
LOSS_ROLES = ("assistant",)
_MAX_ROUNDS = 60


def escape(text: Column) -> Column:
    """Break control strings reversibly."""
    return F.regexp_replace(text, _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    """Undo ``escape``."""
    return F.regexp_replace(text, _ESCAPED, "$1")


def as_chains(turns: DataFrame) -> DataFrame:
    """Messages (tree, node, parent, score, role, text) of plain conversations
    (``conv_id``, ``turn``, ``role``, ``text``): each turn answers the one before."""
    rows = turns.select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("h"))
    rows = staged(with_row_numbers(rows, [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("h")], "node"), "turns")
    before = rows.select((F.col("node") + 1).alias("after"), F.col("conv_id").alias("tree_before"))
    parent = F.when(F.col("after").isNotNull() & F.col("conv_id").eqNullSafe(F.col("tree_before")), F.col("node") - 1)
    return rows.join(before, rows["node"] == before["after"], "left").select(
        F.col("conv_id").alias("tree"), "node", parent.alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def chosen_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, place, node, depth) of the messages on the ``top`` best paths
    of each tree; ``place`` ranks the path, ``depth`` counts from 1 at the root."""
    links = messages.select("tree", "node", F.col("parent").alias("ptr"), F.coalesce("score", F.lit(0.0)).alias("sum"), F.lit(1).cast("long").alias("depth"))
    state, jumps = staged(links, "jump"), []
    reached = state.where("ptr is null")  # messages whose sums go up to the root: they take no part in later rounds
    while not (going := state.where("ptr is not null")).isEmpty():
        if len(jumps) == _MAX_ROUNDS:
            raise ValueError("replies form a cycle")
        jumps.append(going.select("node", "ptr"))
        upper = reached.unionByName(going).select(F.col("node").alias("up"), F.col("ptr").alias("up_ptr"), F.col("sum").alias("up_sum"), F.col("depth").alias("up_depth"))
        state = staged(going.join(upper, F.col("ptr") == F.col("up"), "left").select(
            "tree", "node", F.col("up_ptr").alias("ptr"), (F.col("sum") + F.coalesce("up_sum", F.lit(0.0))).alias("sum"),
            (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth")), "jump")
        reached = reached.unionByName(state.where("ptr is null"))
    state = reached
    answered = messages.where("parent is not null").select(F.col("parent").alias("node"))
    leaves = state.join(answered, "node", "left_anti")
    best = F.expr("row_number() over (partition by tree order by sum / depth desc, depth desc, node)")
    path = leaves.withColumn("place", best).where(F.col("place") <= top).select("tree", F.col("node").alias("leaf"), "place", "node")
    for jump in reversed(jumps):  # distances with this binary digit
        path = staged(path.unionByName(path.join(jump, "node").where("ptr is not null").select("tree", "leaf", "place", F.col("ptr").alias("node"))), "path")
    # a jump to a missing parent ends at no message
    return path.join(state.select("node", "depth"), "node")


def format_paths(messages: DataFrame, paths: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """tree, leaf, formatted, loss_spans (start, end) of each chosen path."""
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    pieces = messages.select("node", role.alias("role"), F.concat(F.lit(OPEN), F.url_encode(role), F.lit("\n")).alias("head"), text.alias("body"))
    pieces = paths.join(pieces, "node").withColumn("size", F.length("head") + F.length("body") + len(CLOSE) + 1)
    start = F.coalesce(F.expr("sum(size) over (partition by tree, leaf order by depth rows between unbounded preceding and 1 preceding)"), F.lit(0))
    pieces = pieces.withColumn("from", start + F.length("head"))
    span = F.when(F.col("role").isin(*loss_roles), F.struct(F.col("from").alias("start"), (F.col("from") + F.length("body")).alias("end")))
    turn = F.struct("depth", F.concat("head", "body", F.lit(CLOSE + "\n")).alias("piece"), span.alias("span"))
    turns = pieces.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return turns.select("tree", "leaf", F.array_join("turns.piece", "").alias("formatted"),
                        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    pieces = F.split(formatted, CLOSE.replace("|", r"\|") + "\n")

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        role = F.url_decode(F.substr(head, F.lit(len(OPEN) + 1)))
        return F.struct(role.alias("role"), unescape(F.substr(p, F.length(head) + 2)).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """Text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
