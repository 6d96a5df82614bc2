"""Condensed tree and selection by joins against the whole dendrogram of each run."""

import os

import numpy as np
import pandas as pd
import pytest

from botqa.operators import condense as K
from dendrogram import eom_labels


def _tree(rng, n, shape, ids):
    """Edges of a tree: a chain, a star, random attachment or blobs; weights with ties and zeros."""
    to = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: int(rng.integers(0, i)),
          "blobs": lambda i: i - 1 if i % 9 else int(rng.integers(0, i))}[shape]
    rows = []
    for i in range(1, n):
        w = float(rng.choice([rng.random(), 0.25, 0.5, 0.0 if shape == "star" else 0.75]))
        if shape == "blobs" and i % 9 == 0:
            w = float(2 + rng.integers(0, 5))
        a, b = ids[i], ids[to(i)]
        rows.append((min(a, b), max(a, b), w))
    return rows


def _compare(spark, runs, least):
    points = spark.createDataFrame([(r, p) for r, (ids, _) in runs.items() for p in ids], "run string, pid long")
    tree = spark.createDataFrame([(r, *e) for r, (_, es) in runs.items() for e in es], "run string, a long, b long, w double")
    got = K.condense_and_select(points, tree, least).toPandas()
    assert len(got) == sum(len(ids) for ids, _ in runs.values())
    found = 0
    for r, (ids, es) in runs.items():
        pids = np.sort(np.array(ids))
        want = eom_labels(pids, pd.DataFrame(es, columns=["a", "b", "w"]), least)
        mine = got[got.run == r].sort_values("pid").cluster.tolist()
        assert mine == want.tolist(), r
        found += want.max() + 1
    return found


@pytest.mark.parametrize("least", [2, 3, 5])
def test_random_trees(spark, least):
    rng, runs = np.random.default_rng(least), {}
    for i in range(40):
        n = int(rng.integers(2, 90))
        ids = (rng.permutation(1000)[:n] - 200).tolist()
        shape = ["chain", "star", "random", "blobs"][i % 4]
        runs[f"{shape}{i}"] = (ids, _tree(rng, n, shape, ids))
    assert _compare(spark, runs, least) > 40


def test_a_deep_nest_of_clusters(spark):
    """Triples joined one after the other at growing distances, with points that fall
    out of every ancestor: the condensed tree is a chain of 60 splits."""
    es, ids = [], []
    for k in range(60):
        a = 10 * k
        ids += [a, a + 1, a + 2, a + 3]
        es += [(a, a + 1, 0.1 + k / 1e4), (a + 1, a + 2, 0.1 + k / 1e4), (a + 2, a + 3, 1.05 + (k * 7 % 60) / 10)]
        if k:
            es.append((a - 10, a, 1.0 + k / 10))
    assert _compare(spark, {"deep": (ids, es)}, 3) > 1


def test_two_trees_in_one_run_and_small_runs(spark):
    """Trees without a link between them, one point, two points, no points."""
    runs = {"one": ([5], []), "two": ([5, 6], [(5, 6, 0.5)])}
    rng = np.random.default_rng(1)
    ids = list(range(60))
    runs["blobs"] = (ids, _tree(rng, 60, "blobs", ids))
    _compare(spark, runs, 3)
    left = [(a + 100, b + 100, w) for a, b, w in runs["blobs"][1]]
    points = spark.createDataFrame([("r", p) for p in [*ids, *[i + 100 for i in ids]]], "run string, pid long")
    tree = spark.createDataFrame([("r", *e) for e in [*runs["blobs"][1], *left]], "run string, a long, b long, w double")
    got = {r.pid: r.cluster for r in K.condense_and_select(points, tree, 3).collect()}
    alone = eom_labels(np.array(ids), pd.DataFrame(runs["blobs"][1], columns=["a", "b", "w"]), 3)
    for at in (0, 100):
        mine = [got[i + at] for i in ids]
        assert [x == -1 for x in mine] == [x == -1 for x in alone]
        assert len(set(zip(mine, alone.tolist(), strict=True))) == len(set(alone.tolist()))
    assert not {got[i] for i in ids} & {got[i + 100] for i in ids} - {-1}
    assert K.condense_and_select(points.limit(0), tree.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        K.condense_and_select(points, tree, 1)


def test_only_splits_are_grouped(spark, monkeypatch, tmp_path):
    """The rows that one group gets grow with the splits, not with the points."""
    seen = str(tmp_path)
    plain = K._nested

    def counted(splits):
        open(f"{seen}/{len(splits)}-{splits['run'].iloc[0]}", "w").close()
        return plain(splits)

    monkeypatch.setattr(K, "_nested", counted)
    rng, es = np.random.default_rng(3), []
    for i in range(1, 3000):     # three blobs of 1,000 points
        es.append((i - 1, i, 50.0) if i % 1000 == 0 else (i - int(rng.integers(1, i % 1000 + 1)), i, float(0.1 + rng.random() / 1e3 + i / 1e6)))
    runs = {"r": (list(range(3000)), es)}
    assert _compare(spark, runs, 3) >= 2
    rows = int(os.listdir(seen)[0].split("-")[0])
    assert 2 <= rows < 3000 / 3
