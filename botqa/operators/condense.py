"""Condensed tree and excess-of-mass selection of density clustering (U-03), from
the edges of each run's minimum spanning tree.

Edges are ordered by (weight, lower end, higher end).  A *part* is what the edges up
to some edge connect, a part of at least ``least`` points is *big*.  Two facts make
the condensed tree a matter of joins:

* The edge ``t`` by which the part of a point becomes big is found by growing the
  part along its lightest edges, ``least`` - 1 times.  That edge is where the point
  falls out of the condensed tree.
* An edge splits a condensed cluster in two exactly if both ends have a smaller
  ``t``.  All others only add points to a big part, so each point whose ``t`` meets a
  big part points at the end that lies in it, and following these pointers (pointer
  jumping) gives its leaf cluster: the big part that came about there from small ones.

Only the splits are nested one in another, in one group per run of two rows per split
(at most 2 n / least; points that fall out of a cluster make no rows).  A point whose
``t`` is above the birth of its leaf cluster climbs to the ancestor that it falls out
of by jumps of 2^k ancestors, one join each.  What the points add to the excess of
mass of a cluster is an aggregate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_EDGE = "struct<w: double, lo: bigint, hi: bigint>"
#: Density of a distance of zero, and the share by which masses may differ and count as equal
#: (sums of doubles depend on the order of rows in their last bits).
_DENSEST, _EQUAL = 1e300, 1e-9
_NEST = "run string, cid long, leaf long, parent long, first long, second long, w double, lo long, hi long"


def _edge(source: str = "") -> Column:
    return F.struct(*[F.col(f"{source}{c}").alias(c) for c in ("w", "lo", "hi")])


def _density(w: Column) -> Column:
    """1 / distance; 0 for the root, which has no distance."""
    return F.when(w.isNull(), 0.0).when(w <= 0, _DENSEST).otherwise(F.least(1 / w, F.lit(_DENSEST)))


def fall_out_edges(edges: DataFrame, least: int) -> DataFrame:
    """(run, pid, t): the edge by which the part of a point first has ``least`` points.
    Points of a tree with fewer points have no row.  ``least`` edges a point are
    enough, as fewer of them can lie inside a small part."""
    ends = [edges.select("run", F.col(x).alias("pid"), F.struct("w", "lo", "hi", F.col(y).alias("to")).alias("e"))
            for x, y in (("lo", "hi"), ("hi", "lo"))]
    ranked = ends[0].unionByName(ends[1]).withColumn("_r", F.row_number().over(Window.partitionBy("run", "pid").orderBy("e")))
    near = ranked.where(F.col("_r") <= least).groupBy("run", "pid").agg(F.sort_array(F.collect_list("e")).alias("near"))
    look = near.select("run", F.col("pid").alias("next"), "near")
    part = near.select("run", "pid", F.array("pid").alias("part"), F.col("near").alias("out"), F.lit(None).cast(_EDGE).alias("t"))
    for step in range(1, least):
        free = F.array_min(F.filter("out", lambda e: ~F.array_contains(F.col("part"), e["to"])))
        part = part.withColumn("e", free).where("e is not null").withColumn("t", F.greatest("t", _edge("e.")))
        if step < least - 1:
            part = part.withColumn("next", F.col("e.to")).join(look, ["run", "next"]).select(
                "run", "pid", F.array_append("part", F.col("next")).alias("part"), F.concat("out", "near").alias("out"), "t")
    return part.select("run", "pid", "t")


def _jumped(pointers: DataFrame) -> DataFrame:
    a, b = pointers.alias("a"), pointers.alias("b")
    return a.join(b, (F.col("a.run") == F.col("b.run")) & (F.col("a.to") == F.col("b.pid"))).select("a.run", "a.pid", "b.to")


def _settled(pointers: DataFrame) -> DataFrame:
    """(run, pid, to) with each pointer followed to its end, a row that points at itself.
    A pass makes each pointer four times as long and counts those that moved at its end."""
    pointers = cut_lineage(pointers, "leaf")
    for _ in range(32):
        half, moved = _jumped(pointers), Observation()
        a, b = half.alias("a"), half.alias("b")
        far = a.join(b, (F.col("a.run") == F.col("b.run")) & (F.col("a.to") == F.col("b.pid"))).select(
            "a.run", "a.pid", "b.to", (F.col("a.to") != F.col("b.to")).alias("moved"))
        pointers = cut_lineage(far.observe(moved, F.count_if("moved").alias("n")).drop("moved"), "leaf")
        if not moved.get["n"]:
            return pointers
    raise RuntimeError("pointers did not settle")


def _nested(splits: pd.DataFrame) -> pd.DataFrame:
    """The condensed clusters of a run: leaves first, then one per split in ascending
    order, each with its parent, its two children (the lower end's first) and the
    edge at which its parent splits."""
    splits = splits.sort_values(["w", "lo", "hi"], ignore_index=True)
    leaves, ends = np.unique(splits[["leaf_lo", "leaf_hi"]].to_numpy(), return_inverse=True)
    n, total = len(leaves), len(leaves) + len(splits)
    parent, kids = np.full(total, -1), np.full((total, 2), -1)
    up = list(range(total))
    for i, pair in enumerate(ends.reshape(-1, 2).tolist()):
        for side, x in enumerate(pair):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            up[x] = parent[x] = n + i
            kids[n + i, side] = x
    whole = lambda values, given: pd.Series(values, dtype="Int64").where(given)
    root, split = parent < 0, kids[:, 0] >= 0
    born = splits.iloc[np.where(root, 0, parent - n)].reset_index(drop=True)
    return pd.DataFrame({"run": splits["run"].iloc[0], "cid": np.arange(total),
                         "leaf": whole(np.r_[leaves, np.zeros(total - n, np.int64)], ~split), "parent": whole(parent, ~root),
                         "first": whole(kids[:, 0], split), "second": whole(kids[:, 1], split),
                         "w": pd.Series(born["w"], dtype="Float64").where(~root), "lo": whole(born["lo"], ~root), "hi": whole(born["hi"], ~root)})


def _climbed(points: DataFrame, nest: DataFrame) -> DataFrame:
    """``points`` (run, pid, t, cid) whose cluster is born below ``t``: the ancestor that
    they fall out of, the lowest one born above ``t`` or never."""
    born = nest.where("parent is not null").select("run", "cid", F.col("parent").alias("up"))
    hop = cut_lineage(born.join(nest.where("w is not null").select("run", F.col("cid").alias("up"), _edge().alias("key")), ["run", "up"]), "hops")
    hops = []
    while not hop.isEmpty():
        hops.append(hop)
        a, b = hop.alias("a"), hop.alias("b")
        hop = cut_lineage(a.join(b, (F.col("a.run") == F.col("b.run")) & (F.col("a.up") == F.col("b.cid")))
                          .select("a.run", "a.cid", "b.up", "b.key"), "hops")
    for hop in reversed(hops):
        points = points.join(hop, ["run", "cid"], "left").select(
            "run", "pid", "t", F.when(F.col("key") < F.col("t"), F.col("up")).otherwise(F.col("cid")).alias("cid"))
    return points.join(born, ["run", "cid"]).select("run", "pid", "t", F.col("up").alias("cid"))


def _chosen(tree: pd.DataFrame) -> pd.DataFrame:
    """The label of each condensed cluster that is chosen or lies in a chosen one.
    Leaves up, a cluster is kept if its own excess of mass is not below that of the
    best choice inside it; the root is never kept."""
    tree = tree.sort_values("cid", ignore_index=True)
    parent, first, second = (tree[c].fillna(-1).to_numpy(np.int64) for c in ("parent", "first", "second"))
    size, mass, birth = (tree[c].fillna(0).to_numpy(np.float64) for c in ("points", "mass", "birth"))
    keep = first < 0
    for c in np.flatnonzero(~keep):
        kids = [first[c], second[c]]
        size[c] += size[kids].sum()
        inner = mass[kids].sum()
        mass[c] += (size[kids] * (birth[kids] - birth[c])).sum()
        keep[c] = parent[c] >= 0 and mass[c] >= inner - _EQUAL * abs(inner)
        mass[c] = mass[c] if keep[c] else inner
    label, given, stack = np.full(len(tree), -1), [], list(np.flatnonzero(parent < 0))
    number = np.zeros(len(tree), np.int64)
    while stack:
        c = stack.pop()
        for k in (first[c], second[c]):
            if k >= 0:
                given.append(k)
                number[k] = len(given)
                label[k] = label[c] if label[c] >= 0 else (k if keep[k] else -1)
                stack.append(k)
    heads = sorted((c for c in range(len(tree)) if label[c] == c), key=lambda c: number[c])
    order = np.full(len(tree) + 1, -1)
    order[heads] = np.arange(len(heads))
    return pd.DataFrame({"run": tree["run"].iloc[0], "cid": tree["cid"], "cluster": order[label]})


def condense_and_select(points: DataFrame, tree: DataFrame, least: int) -> DataFrame:
    """(run, pid, cluster) of all ``points``, -1 for noise, from the spanning ``tree``
    (run, a, b, w with a < b)."""
    if least < 2:
        raise ValueError("a cluster has at least two points")
    noise = points.select("run", "pid", F.lit(-1).cast("long").alias("cluster"))
    edges = cut_lineage(tree.select("run", "w", F.col("a").alias("lo"), F.col("b").alias("hi")), "tree")
    fall = cut_lineage(fall_out_edges(edges, least), "fall_out")
    ends = edges
    for end in ("lo", "hi"):
        ends = ends.join(fall.select("run", F.col("pid").alias(end), F.col("t").alias(f"t_{end}")), ["run", end])
    ends = cut_lineage(ends.select("run", _edge().alias("t"), "t_lo", "t_hi"), "tree_ends")
    splits = ends.where("t_lo < t and t_hi < t").select("run", "t.*")
    if splits.isEmpty():
        return noise
    # of an edge by which a point falls out, the end in the big part; the lower end if it makes one
    to = F.when((F.col("t_lo") < F.col("t")) | (F.col("t_hi") == F.col("t")), F.col("t.lo")).otherwise(F.col("t.hi"))
    leaf = _settled(fall.join(ends, ["run", "t"]).select("run", "pid", to.alias("to")))
    for end in ("lo", "hi"):
        splits = splits.join(leaf.select("run", F.col("pid").alias(end), F.col("to").alias(f"leaf_{end}")), ["run", end])
    nest = cut_lineage(splits.groupBy("run").applyInPandas(_nested, _NEST), "nest")
    placed = cut_lineage(fall.join(leaf, ["run", "pid"]).join(nest.select("run", F.col("leaf").alias("to"), "cid", _edge().alias("born")), ["run", "to"])
                         .select("run", "pid", "t", "cid", (F.col("born") < F.col("t")).alias("climbs")), "placed")
    stay = placed.where("not climbs").select("run", "pid", "t", "cid")
    held = cut_lineage(stay.unionByName(_climbed(placed.where("climbs").select("run", "pid", "t", "cid"), nest)), "held")
    births = nest.select("run", "cid", "parent", "first", "second", _density(F.col("w")).alias("birth"))
    gained = (held.join(births.select("run", "cid", "birth"), ["run", "cid"]).groupBy("run", "cid")
              .agg(F.count(F.lit(1)).alias("points"), F.sum(_density(F.col("t.w")) - F.col("birth")).alias("mass")))
    labels = (births.join(gained, ["run", "cid"], "left").groupBy("run")
              .applyInPandas(_chosen, "run string, cid long, cluster long"))
    labelled = held.join(labels, ["run", "cid"]).select("run", "pid", F.col("cluster").alias("label"))
    return noise.join(labelled, ["run", "pid"], "left").select("run", "pid", F.coalesce("label", "cluster").alias("cluster"))
