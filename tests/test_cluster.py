"""Density clustering vs a brute-force restatement (dense Prim MST) on blobs + noise;
invariance to block size (partitioning of the work)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from botqa.operators import cluster as C
from dendrogram import eom_labels


def _data(seed=0, runs=("r_a", "r_b"), per=12, dim=6):
    rng = np.random.default_rng(seed)
    rows, pid = [], 0
    for run in runs:
        for c in rng.normal(0, 10, size=(3, dim)):
            for _ in range(per):
                rows.append((run, pid, (c + rng.normal(0, 0.3, dim)).tolist()))
                pid += 1
        for _ in range(4):
            rows.append((run, pid, rng.normal(0, 40, dim).tolist()))
            pid += 1
    return rows


def _brute(rows, run):
    sub = [r for r in rows if r[0] == run]
    pids = np.array([r[1] for r in sub])
    X = np.array([r[2] for r in sub])
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    Dn = D.copy()
    np.fill_diagonal(Dn, np.inf)
    core = Dn.min(1)
    M = np.maximum(np.maximum(D, core[:, None]), core[None, :])
    n = len(X)
    inT = np.zeros(n, bool)
    inT[0] = True
    best, src, edges = M[0].copy(), np.zeros(n, int), []
    for _ in range(n - 1):
        best[inT] = np.inf
        j = int(np.argmin(best))
        edges.append((min(pids[src[j]], pids[j]), max(pids[src[j]], pids[j]), best[j]))
        inT[j] = True
        upd = M[j] < best
        src[upd] = j
        best = np.minimum(best, M[j])
    e = pd.DataFrame(edges, columns=["a", "b", "w"])
    return eom_labels(np.sort(pids), e, 3), e["w"].sum()


@pytest.mark.parametrize("block", [8, 1024])
def test_matches_brute_force(spark, block):
    rows = _data()
    df = spark.createDataFrame(rows, "run_id string, result_id long, embedding array<double>")
    out = C.density_clusters(df, block_size=block).toPandas()
    for run in ("r_a", "r_b"):
        lab, _ = _brute(rows, run)
        got = out[out.run_id == run].sort_values("result_id").cluster.tolist()
        assert got == lab.tolist()
        assert sum(1 for x in got if x == -1) == 4 and len(set(got) - {-1}) == 3


def test_mst_weight_equals_prim(spark):
    rows = _data(seed=5, runs=("r",), per=8)
    df = spark.createDataFrame(rows, "run_id string, result_id long, embedding array<double>")
    pts = df.selectExpr("run_id AS run", "result_id AS pid", "embedding AS vec")
    core = C.core_distances(pts, 2, block_size=7)
    tree = C.mst(pts, core, block_size=7).toPandas()
    _, w = _brute(rows, "r")
    assert len(tree) == len(rows) - 1
    assert abs(tree.w.sum() - w) < 1e-9


def _excess_of_mass(vectors, least=3):
    """Clusters of one run from the full matrix, top down: an independent
    restatement without a spanning tree or a dendrogram."""
    d = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(-1))
    off = d.copy()
    np.fill_diagonal(off, np.inf)
    core = off.min(1)
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))

    def parts(members, below):
        left, found = set(members), []
        while left:
            group, edge = set(), [left.pop()]
            while edge:
                x = edge.pop()
                group.add(x)
                near = [y for y in left if reach[x, y] < below]
                left.difference_update(near)
                edge += near
            found.append(sorted(group))
        return found

    def best(members, birth, root=False):
        """(excess of mass, clusters chosen) of the cluster that starts as ``members``."""
        everyone, mass = list(members), 0.0
        heights = np.unique(reach[np.ix_(members, members)][~np.eye(len(members), dtype=bool)])[::-1]
        for height in heights:
            split = parts(members, height)
            if len(split) == 1:
                continue
            big = [p for p in split if len(p) >= least]
            stay = big[0] if len(big) == 1 else []
            mass += (len(members) - len(stay)) * (1 / height - birth)
            if len(big) == 1:
                members = stay
                continue
            kids = [best(p, 1 / height) for p in big]
            inner = sum(k[0] for k in kids)
            if kids and (root or inner > mass):
                return inner, [c for k in kids for c in k[1]]
            break
        return mass, ([] if root else [everyone])

    return {frozenset(c) for c in best(list(range(len(vectors))), 0.0, root=True)[1]}


@pytest.mark.parametrize("seed", range(6))
def test_selection_equals_an_independent_restatement(spark, seed):
    """Blobs of unlike density, some inside others, and noise."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, s, (n, 3)) for c, s, n in [(0, 1.0, 14), (4, 0.2, 9), (4.9, 0.2, 6), (-6, 0.5, 5), (12, 3.0, 8)]]
    vectors = np.concatenate([*parts, rng.uniform(-15, 15, (5, 3))])
    points = spark.createDataFrame([("r", i, [float(x) for x in v]) for i, v in enumerate(vectors)],
                                   "run_id string, result_id long, embedding array<double>")
    rows = C.density_clusters(points, block_size=16).collect()
    got = {}
    for r in rows:
        got.setdefault(r.cluster, set()).add(r.result_id)
    got.pop(-1, None)
    assert {frozenset(c) for c in got.values()} == _excess_of_mass(vectors)


def test_small_runs_are_not_clustered(spark):
    rows = [("tiny", i, [float(i), 0.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "run_id string, result_id long, embedding array<double>")
    out = C.density_clusters(df).collect()
    assert all(r.cluster is None for r in out) and len(out) == 4


def test_labels_do_not_depend_on_the_block_size(spark):
    """Many ties and exact copies; more points than one tile of a block pair holds."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 3, (150, 64)).astype(float) / 7
    vectors = np.concatenate([base, base, base[:60] + 1e-7, rng.integers(0, 2, (340, 64)) / 3.0])
    points = spark.createDataFrame([("r", int(i), [float(x) for x in v]) for i, v in enumerate(vectors)],
                                   "run_id string, result_id long, embedding array<double>")
    labels = {}
    for size in (64, 400, 1024):
        rows = C.density_clusters(points, block_size=size).collect()
        labels[size] = sorted((r.result_id, r.cluster) for r in rows)
    assert labels[64] == labels[400] == labels[1024]
    a, b = vectors[:100], vectors[50:700]
    assert (C._dist(a, b) == C._dist(b, a).T).all()


def test_an_incomplete_forest_is_an_error(spark):
    """Pairs of pairs of pairs take three rounds, and no fourth one to see that they are done."""
    at = [float(100 * (i // 4) + 10 * (i // 2 % 2) + i % 2) for i in range(8)]
    points = spark.createDataFrame([("r", i, [x]) for i, x in enumerate(at)], "run string, pid long, vec array<double>")
    core = points.select("run", "pid", F.lit(0.0).alias("core"))
    with pytest.raises(RuntimeError, match="not complete"):
        C.mst(points, core, max_rounds=2)
    tree = C.mst(points, core, max_rounds=3).collect()
    assert sorted(r.w for r in tree) == [1.0] * 4 + [9.0] * 2 + [89.0]


def test_text_embeddings_weigh_rare_words(spark):
    import math
    texts = ["common alpha", "common beta beta", "common"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, actual_response string")
    a, b, c = (r["embedding"] for r in C.text_embeddings(df, dim=1 << 12).orderBy("id").collect())
    assert sum(x * x for x in a) == pytest.approx(1) and sum(x * x for x in b) == pytest.approx(1)
    assert math.sumprod(a, b) == pytest.approx(0)  # the word that all share weighs nothing
    assert not any(c)
    assert C.text_embeddings(df.limit(0)).count() == 0


def test_tiles_give_the_least_weight_of_direct_differences(monkeypatch):
    """Matrix products only narrow the search: weights are those of direct differences to the
    last bit and ties go to the first row, for copies, near copies, lattices and all scales."""
    monkeypatch.setattr(C, "_ROWS", 16)
    monkeypatch.setattr(C, "_COLUMNS", 32)
    rng = np.random.default_rng(3)
    for case in range(80):
        dim, n, m = (int(x) for x in rng.integers(1, [70, 90, 120]))
        a, b = rng.normal(size=(n, dim)), rng.normal(size=(m, dim))
        if case % 4 == 1:
            a, b = (rng.integers(0, 3, x.shape) / 7.0 for x in (a, b))
        elif case % 4 == 2:
            base = rng.normal(size=(9, dim)) + 100
            a, b = base[rng.integers(0, 9, n)], base[rng.integers(0, 9, m)] + (rng.random((m, 1)) < 0.5) * 1e-7
        elif case % 4 == 3:
            a, b = a * 10.0 ** rng.integers(-8, 8), b * 10.0 ** rng.integers(-8, 8)
        a_core, b_core = (rng.choice([0.0, 0.1, 1.0], len(x)) for x in (a, b))
        a_mark, b_mark = (rng.integers(0, 20, len(x)) for x in (a, b))
        w = np.maximum(np.maximum(C._dist(a, b), a_core[:, None]), b_core[None])
        w[a_mark[:, None] == b_mark[None]] = np.inf
        best, at = C._lightest(a, b, a_core, b_core, a_mark, b_mark)
        assert (best == w.min(axis=1)).all()
        assert (at == w.argmin(axis=1))[np.isfinite(best)].all()


def test_points_are_copied_to_a_bounded_number_of_blocks_and_not_searched_again(spark, monkeypatch):
    """A run of 3000 points makes 16 blocks of any size; once components are large, points whose
    edge still leads out of them, or that lie deep inside, are not searched again."""
    searched, over_pairs = [], C._over_pairs

    def counted(left, right, *rest):
        searched.append((left.count(), right.count()))
        return over_pairs(left, right, *rest)

    monkeypatch.setattr(C, "_over_pairs", counted)
    rng = np.random.default_rng(8)
    vectors = rng.normal(0, 1, (3000, 8))
    points = spark.createDataFrame([("r", i, [float(x) for x in v]) for i, v in enumerate(vectors)], "run string, pid long, vec array<double>")
    assert C._dealt(points, 8, "i").agg(F.max("is")).first()[0] == C._PARTS
    tree = C.mst(points, C.core_distances(points, block_size=400), block_size=400)
    assert tree.count() == 2999
    rounds = [n for n, _ in searched[1:]]
    assert rounds[:2] == [3000, 3000] and len(rounds) > 3 and sum(rounds[2:]) < 3000


def test_points_without_a_vector_are_noise(spark):
    rows = [*[("r", i, [float(i // 3), 0.0]) for i in range(9)], ("r", 9, None)]
    df = spark.createDataFrame(rows, "run_id string, result_id long, embedding array<double>")
    out = {r.result_id: r.cluster for r in C.density_clusters(df).collect()}
    assert out[9] == -1 and len({out[i] for i in range(9)}) == 3
