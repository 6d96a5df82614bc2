"""Density clustering of failure embeddings per run (C-01, C-02, C-03; HDBSCAN
as published by Campello, Moulavi and Sander, 2013): core distances, minimum
spanning tree of the mutual-reachability graph, condensed tree and
excess-of-mass cluster selection.

Distributed plan, exact and without materialising all pairs:

* points of a run are hashed into blocks of ``block_size`` points, at most
  ``_PARTS`` of them (larger blocks beyond that, up to ``_MOST`` points), so a
  point is copied to a bounded number of block pairs.  A block pair is a co-group
  of its points; a numpy kernel goes over it in tiles and only emits a minimum
  per point.  Distances of a tile come from one matrix product; all pairs that
  could be a row's minimum within its rounding error are then computed from
  direct differences, so results are exact.
* core distance = distance to the ``min_samples``-th nearest point counting the
  point itself (as the reference library does), i.e. the nearest *other*
  point for ``min_samples = 2``.
* MST by Borůvka rounds: each point's lightest edge to another component,
  reduced to the lightest edge per component (ties broken by (w, lo, hi), so
  the result is a unique MST); components merge by pointer jumping on the
  small chosen-edge table; every round is written to the shared checkpoint
  folder, ~log2(n) rounds.  A point keeps its edge while that leads out of its
  component; an edge that no longer does is a lower bound, and the point is
  searched again only if the bound does not exceed the lightest edge that its
  component still has.
* condensed tree and excess-of-mass selection (U-03) by joins over the tree
  edges (``condense``); only the splits of a run are nested in one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas as S
from ..session import cut_lineage
from .condense import condense_and_select

_INF = float("inf")


# ---------------------------------------------------------------------------
# C-01 embeddings (text fallback)
# ---------------------------------------------------------------------------
def text_embeddings(df: DataFrame, text_col: str = "actual_response", dim: int = 256) -> DataFrame:
    """C-01 fallback when no embedding column is given: hashed term
    frequencies (MLlib HashingTF over a regex tokenizer) weighted by inverse
    document frequency and L2-normalised.  The frequencies of all rows are
    counted when this is called; ``dim`` numbers reach the driver."""
    from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"\W+", minTokenLength=1)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    idf = IDF(inputCol="_tf", outputCol="_weighted")
    norm = Normalizer(inputCol="_weighted", outputCol="_vec", p=2.0)
    from pyspark.ml.functions import vector_to_array
    counted = tf.transform(tok.transform(df))
    weighted = counted.withColumn("_weighted", F.col("_tf")) if counted.isEmpty() else idf.fit(counted).transform(counted)
    return (norm.transform(weighted).withColumn("embedding", vector_to_array("_vec", "float32"))
            .drop("_tok", "_tf", "_weighted", "_vec"))


# ---------------------------------------------------------------------------
# block-pair machinery
# ---------------------------------------------------------------------------
#: Blocks of a run, unless they would hold more than ``_MOST`` points.
_PARTS, _MOST = 16, 1 << 16


def _dealt(points: DataFrame, block_size: int, part: str) -> DataFrame:
    """``points`` with their block ``part`` and the number of blocks of their run."""
    n = points.groupBy("run").agg(F.count(F.lit(1)).alias("_n"))
    blocks = F.least(F.ceil(F.col("_n") / F.lit(block_size)), F.greatest(F.lit(_PARTS), F.ceil(F.col("_n") / F.lit(_MOST)))).cast("int")
    sizes = n.select("run", F.greatest(F.lit(1), blocks).alias(f"{part}s"))
    return points.join(sizes, "run").withColumn(part, F.pmod(F.xxhash64("pid"), F.col(f"{part}s")).cast("int"))


def _over_pairs(left: DataFrame, right: DataFrame, block_size: int, kernel, schema: str) -> DataFrame:
    """``kernel`` (left points, right points) of all block pairs of each run."""
    a, b = _dealt(left, block_size, "i"), _dealt(right, block_size, "j")
    across = lambda t, other, part: t.join(other.select("run", f"{part}s").distinct(), "run").withColumn(
        part, F.explode(F.sequence(F.lit(0), F.col(f"{part}s") - 1)))
    a, b = (across(x, y, part).drop("is", "js") for x, y, part in ((a, b, "j"), (b, a, "i")))
    a, b = (x.select(*[F.col(c).alias(c) for c in x.columns]).groupBy("run", "i", "j") for x in (a, b))  # columns of its own for each side
    none = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[f.dataType.simpleString()])
                      for f in StructType.fromDDL(schema)]).empty_table()

    def run(key, some: pa.Table, others: pa.Table) -> pa.Table:
        return kernel(key, some, others) if len(some) and len(others) else none
    return a.cogroup(b).applyInArrow(run, schema)


def _arrays(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns of a table in the order of ``pid``; ``vec`` as a matrix."""
    table = table.sort_by("pid").combine_chunks()
    found = []
    for c in names:
        column = table[c].combine_chunks()
        whole = column.flatten() if c == "vec" else column
        found.append(whole.to_numpy(zero_copy_only=False).reshape((len(table), -1) if c == "vec" else -1))
    return found


#: Entries of the difference tensor a task holds at a time (8 bytes each).
_TILE = 4_000_000


def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances by direct differences: symmetric to the last bit and zero for
    copies, whatever the block size.  Tiled over ``b`` to bound memory."""
    out = np.empty((a.shape[0], b.shape[0]))
    step = max(1, _TILE // max(1, a.size))
    for i in range(0, b.shape[0], step):
        out[:, i:i + step] = np.sqrt(((a[:, None, :] - b[None, i:i + step, :]) ** 2).sum(-1))
    return out


#: Rows and columns of the tiles that a block pair is gone over in.
_ROWS, _COLUMNS = 512, 2048


def _exact(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The entries (row, col) of ``_dist(a, b)``."""
    out, step = np.empty(len(row)), max(1, _TILE // max(1, a.shape[1]))
    for i in range(0, len(row), step):
        out[i:i + step] = np.sqrt(((a[row[i:i + step]] - b[col[i:i + step]]) ** 2).sum(-1))
    return out


def _lightest(a, b, a_core, b_core, a_mark, b_mark) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``a`` the first row of ``b`` of least weight (the largest of the
    distance and both cores) among those with another mark, and that weight; infinite
    if there is none.  Squared distances by a matrix product are off by a few units
    in the last place of the squared norms; what comes that close to a row's minimum
    is computed again by differences."""
    best, at = np.full(len(a), _INF), np.zeros(len(a), np.int64)
    if not len(a) or not len(b):
        return best, at
    codes = np.unique(np.concatenate([a_mark, b_mark]), return_inverse=True)[1].astype(np.int32)
    a_code, b_code = codes[:len(a)], codes[len(a):]
    center = b.mean(axis=0)
    x, y = a - center, b - center
    x2, y2 = (x ** 2).sum(-1), (y ** 2).sum(-1)
    off = 8 * (a.shape[1] + 8) * np.finfo(np.float64).eps * (x2 + y2.max() + a_core ** 2 + (b_core ** 2).max()) + np.finfo(np.float64).tiny
    x, y = np.column_stack([-2 * x, x2, np.ones(len(x))]), np.column_stack([y, np.ones(len(y)), y2])
    for r in range(0, len(a), _ROWS):
        rows = slice(r, r + _ROWS)
        least, room, floor = best[rows], off[rows], a_core[rows]
        for c in range(0, len(b), _COLUMNS):
            cols = slice(c, c + _COLUMNS)
            near = x[rows] @ y[cols].T
            np.maximum(near, (b_core[cols] ** 2)[None, :], out=near)
            near[a_code[rows, None] == b_code[None, cols]] = _INF
            limit = np.minimum(np.maximum(near.min(axis=1), floor ** 2), least ** 2) + 2 * room
            open_ = np.flatnonzero((least > floor) & (limit < _INF))  # no weight is below the row's own core
            close = near[open_] <= limit[open_, None]
            some = close.any(axis=1)
            open_, close = open_[some], close[some]

            def weigh(i, j, c=c, r=r):
                d = _exact(a, b, i + r, j + c)
                return np.maximum(np.maximum(d, a_core[i + r]), b_core[j + c])
            first = close.argmax(axis=1)
            w = weigh(open_, first)
            more = np.flatnonzero((w > floor[open_]) & (np.count_nonzero(close, axis=1) > 1))
            if len(more):
                i, j = np.nonzero(close[more])
                every = weigh(open_[more][i], j)
                begin = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                w[more] = np.minimum.reduceat(every, begin)
                hit = np.flatnonzero(every == w[more][i])
                first[more] = j[hit[np.concatenate([[True], i[hit][1:] != i[hit][:-1]])]]
            less = w < least[open_]
            least[open_[less]], at[open_[less] + r] = w[less], first[less] + c
    return best, at


def _found(key, pid: np.ndarray, **columns: np.ndarray) -> pa.Table:
    return pa.table({"run": pa.array([key[0].as_py()] * len(pid), pa.string()), "pid": pid.astype(np.int64), **columns})


def _knn_kernel(k: int):
    """The ``k`` least distances of each left point to other right points."""
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        (lp, lv), (rp, rv) = (_arrays(t, "pid", "vec") for t in (left, right))
        if k == 1:
            best = _lightest(lv, rv, np.zeros(len(lv)), np.zeros(len(rv)), lp, rp)[0][:, None]
        else:
            best = np.full((len(lp), k), _INF)
            for c in range(0, len(rp), _COLUMNS):
                for r in range(0, len(lp), _ROWS):
                    d = _dist(lv[r:r + _ROWS], rv[c:c + _COLUMNS])
                    d[lp[r:r + _ROWS, None] == rp[None, c:c + _COLUMNS]] = _INF          # not the point itself
                    best[r:r + _ROWS] = np.sort(np.concatenate([best[r:r + _ROWS], d], axis=1), axis=1)[:, :k]
        row, col = np.nonzero(np.isfinite(best))
        return _found(key, lp[row], d=best[row, col])
    return run


def core_distances(points: DataFrame, min_samples: int = S.HDBSCAN_MIN_SAMPLES,
                   block_size: int = 1024) -> DataFrame:
    """(run, pid) -> core distance = (min_samples - 1)-th nearest other point.
    Each block pair emits at most k candidates per point; the k-th smallest
    per point is a ``row_number() <= k`` top-k (partial limit before the shuffle)."""
    from pyspark.sql import Window
    k = max(1, min_samples - 1)
    points = points.where("vec is not null").select("run", "pid", "vec")
    cand = _over_pairs(points, points, block_size, _knn_kernel(k), "run string, pid long, d double")
    if k == 1:
        return cand.groupBy("run", "pid").agg(F.min("d").alias("core"))
    w = Window.partitionBy("run", "pid").orderBy("d")
    return (cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == k)
                .select("run", "pid", F.col("d").alias("core")))


def _min_edge_kernel(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """The lightest edge of each left point to a right point of another component.
    The first of equal weights has the smallest pid, which gives the smallest (lo, hi)."""
    (lp, lv, lc, lcomp), (rp, rv, rc, rcomp) = (_arrays(t, "pid", "vec", "core", "comp") for t in (left, right))
    best, at = _lightest(lv, rv, lc, rc, lcomp, rcomp)
    row = np.flatnonzero(np.isfinite(best))
    return _found(key, lp[row], w=best[row], to=rp[at[row]].astype(np.int64))


def _relabel(edges: DataFrame) -> DataFrame:
    """Merge components along their chosen edges: (run, comp, other) -> (run, comp, new).

    Each component points at the component across its lightest edge; with a
    strict edge order the only cycles are pairs (x <-> y).  Pointer jumping
    (p <- p o p) settles every component on x or y in ~log2(depth) joins of
    this small table; the new label is min(x, y)."""
    t = edges.select("run", "comp", "other")
    p = t.select("run", "comp", F.col("other").alias("p"))
    for _ in range(64):
        moved = Observation()
        q = (p.alias("a").join(p.alias("b"), (F.col("a.run") == F.col("b.run")) & (F.col("a.p") == F.col("b.comp")))
              .select("a.run", "a.comp", "b.p", (F.col("a.p") != F.col("b.p")).alias("moved")))
        p = cut_lineage(q.observe(moved, F.count_if("moved").alias("n")).drop("moved"))
        if not moved.get["n"]:
            break
    else:
        raise RuntimeError("pointer jumping did not converge")
    tt = t.select("run", F.col("comp").alias("p"), F.col("other").alias("q"))
    return p.join(tt, ["run", "p"]).select("run", "comp", F.least("p", "q").alias("new"))


def mst(points: DataFrame, core: DataFrame, block_size: int = 1024, max_rounds: int = 64) -> DataFrame:
    """Minimum spanning forest of the mutual-reachability graph per run (Borůvka).

    Each round's lightest edges are already a written table; the forest is
    their union (deduplicated: both ends of an edge may pick it)."""
    fixed = points.where("vec is not null").join(core, ["run", "pid"])
    fixed = cut_lineage(fixed.select("run", "pid", "vec", F.coalesce("core", F.lit(0.0)).alias("core")), "mst_points")
    # of each point: its component and its last edge (w, to)
    st = fixed.select("run", "pid", F.col("pid").alias("comp"), F.lit(None).cast("double").alias("w"), F.lit(None).cast("long").alias("to")).distinct()
    ends = F.least("pid", "to").alias("lo"), F.greatest("pid", "to").alias("hi")
    rounds = []
    for _ in range(max_rounds):
        over = st.join(st.select("run", F.col("pid").alias("to"), F.col("comp").alias("other")), ["run", "to"], "left")
        over = over.withColumn("leads", F.coalesce(F.col("other") != F.col("comp"), F.lit(False)))
        held = over.groupBy("run", "comp").agg(F.min(F.when(F.col("leads"), F.col("w"))).alias("bound"))
        over = cut_lineage(over.join(held, ["run", "comp"]).withColumn(
            "again", ~F.col("leads") & F.coalesce(F.col("w") <= F.col("bound"), F.lit(True))).drop("bound"), "mst_over")
        placed = fixed.join(over.select("run", "pid", "comp", "again"), ["run", "pid"])
        found = _over_pairs(placed.where("again").drop("again"), placed.drop("again"), block_size, _min_edge_kernel,
                            "run string, pid long, w double, to long")
        found = found.groupBy("run", "pid").agg(F.min(F.struct("w", *ends, "to")).alias("e")).select("run", "pid", "e.w", "e.to")
        found = found.join(over.select("run", "pid", "comp"), ["run", "pid"]).join(
            over.select("run", F.col("pid").alias("to"), F.col("comp").alias("other")), ["run", "to"])
        now = cut_lineage(over.where("not again").select("run", "pid", "comp", "w", "to", "other", "leads").unionByName(
            found.select("run", "pid", "comp", "w", "to", "other", F.lit(True).alias("leads"))), "mst_now")
        best = now.where("leads").groupBy("run", "comp").agg(
            F.min(F.struct("w", *ends, "other")).alias("e")).select("run", "comp", "e.*")
        best = cut_lineage(best, "mst_edges")
        if best.limit(1).count() == 0:
            break
        rounds.append(best.select("run", F.col("lo").alias("a"), F.col("hi").alias("b"), "w"))
        lab = cut_lineage(_relabel(best.select("run", "comp", "other")), "mst_labels")
        # runs whose components are all one need no further round
        parted = lab.groupBy("run").agg(F.count_distinct("new").alias("_n")).where("_n > 1").select("run")
        if parted.isEmpty():
            break
        st = (now.select("run", "pid", "comp", "w", "to").join(parted, "run", "left_semi").join(lab, ["run", "comp"], "left")
                 .select("run", "pid", F.coalesce("new", "comp").alias("comp"), "w", "to"))
        st = cut_lineage(st, "mst_state")
    else:
        raise RuntimeError(f"the forest is not complete after {max_rounds} rounds")
    if not rounds:
        return points.sparkSession.createDataFrame([], "run string, a long, b long, w double")
    tree = rounds[0]
    for r in rounds[1:]:
        tree = tree.unionByName(r)
    return tree.distinct()


def density_clusters(vectors: DataFrame, run_col: str = "run_id", id_col: str = "result_id",
                     vec_col: str = "embedding", min_cluster_size: int = S.HDBSCAN_MIN_CLUSTER_SIZE,
                     min_samples: int = S.HDBSCAN_MIN_SAMPLES, block_size: int = 1024,
                     min_failures: int = S.MIN_FAILURES_FOR_CLUSTERING) -> DataFrame:
    """C-02 with the C-03 gate: cluster label per failure; runs with fewer than
    ``min_failures`` failures are not clustered (cluster null)."""
    pts = vectors.select(F.col(run_col).alias("run"), F.col(id_col).alias("pid"),
                         F.col(vec_col).cast("array<double>").alias("vec"))
    n = pts.groupBy("run").agg(F.count(F.lit(1)).alias("_n"))
    big = pts.join(n.where(F.col("_n") >= min_failures).select("run"), "run", "left_semi")
    core = core_distances(big, min_samples, block_size)
    tree = mst(big, core, block_size)
    lab = condense_and_select(big, tree, min_cluster_size)
    out = pts.join(lab, ["run", "pid"], "left").select(
        F.col("run").alias(run_col), F.col("pid").alias(id_col), "cluster")
    return out
