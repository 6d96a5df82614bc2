"""Registered queries: density clustering of failures and cluster patterns
(C-01..C-03, A-04, A-06..A-08).  No SQL oracle exists for HDBSCAN; these are
checked against a brute-force restatement in tests/test_cluster.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import analyze as AN
from ..operators import cluster as C
from ..sources import fixtures as FX
from .registry import register


def _labelled(t):
    v = FX.fail_vecs(t)
    lab = C.density_clusters(v)
    types = F.array(*[F.lit(x) for x in S.FAILURE_TYPES])
    ft = F.when(F.col("label") % 7 == 6, F.lit(None).cast("string")).otherwise(
        F.element_at(types, (F.col("label") % 7 + 1).cast("int")))
    return (lab.join(v.select("result_id", "run_id", "label"), ["run_id", "result_id"])
               .select("run_id", "result_id", F.col("result_id").alias("seq"), "cluster", ft.alias("failure_type")))


@register("C02_density_clusters")
def c02_density_clusters(t):
    """C-02/C-03: HDBSCAN cluster label of every failure embedding (-1 noise)."""
    return _labelled(t).select("run_id", "result_id", "cluster")


@register("C03_clustering_gate", """
SELECT run_id, COUNT(*) AS failures, COUNT(*) >= 5 AS clustered FROM fail_vecs GROUP BY run_id
""")
def c03_gate(t):
    """C-03: runs with at least 5 failures are clustered."""
    return AN.clustering_gate(FX.fail_vecs(t))


@register("A08_cluster_counts")
def a08_cluster_counts(t):
    """A-08: clusters found and noise size per run."""
    return AN.cluster_counts(_labelled(t))


@register("A07_cluster_patterns")
def a07_cluster_patterns(t):
    """A-04/A-07: one pattern per cluster: size, share, dominant type, priority."""
    return AN.cluster_patterns(_labelled(t)).drop("examples", "_first")


@register("A06_noise_patterns")
def a06_noise_patterns(t):
    """A-06: noise points grouped by failure type with the fixed texts (shares of all failures of the run)."""
    return AN.patterns_by_type(_labelled(t), noise=True, only=F.col("cluster") == -1).drop("examples")


@register("K01_failure_patterns")
def k01_failure_patterns(t):
    """A-05..A-07, K-01: clusters, noise and unclustered failures in one pattern table per run, by size."""
    return AN.failure_patterns(_labelled(t)).drop("examples")
