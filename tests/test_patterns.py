"""The pattern table of a run (clusters, noise and failures without a cluster) and the judge panels."""

from pyspark.sql import functions as F

from botqa import schemas as S
from botqa.operators import analyze as AN
from botqa.operators import judge as J

SCHEMA = "run_id string, seq long, cluster int, failure_type string, actual_response string"
ROWS = [
    # run a: cluster 1 (three), noise: two POLICY_VIOLATION and one without a type; cluster 0 (two)
    ("a", 1, 1, "HALLUCINATION", "a1"), ("a", 2, -1, "POLICY_VIOLATION", "a2"), ("a", 3, 1, "INCOMPLETE", "a3"),
    ("a", 4, 1, "HALLUCINATION", "a4"), ("a", 5, -1, None, "a5"), ("a", 6, 0, None, "a6"), ("a", 7, 0, None, "a7"),
    ("a", 8, -1, "POLICY_VIOLATION", "a8"),
    # run b is below the gate
    ("b", 1, None, "CONTEXT_LOSS", "b1"), ("b", 2, None, None, "b2"), ("b", 3, None, "CONTEXT_LOSS", "b3"),
]


def test_pattern_table(spark):
    rows = AN.failure_patterns(spark.createDataFrame(ROWS, SCHEMA)).orderBy("run_id", "pattern_rank").collect()
    got = [(r["run_id"], r["pattern_rank"], r["cluster"], r["failure_type"], r["scenario_count"], r["pct_of_failures"],
            r["examples"], r["cluster_label"]) for r in rows]
    assert got == [
        ("a", 1, 1, "HALLUCINATION", 3, 37.5, ["a1", "a3", "a4"], None),
        ("a", 2, 0, "WRONG_ANSWER", 2, 25.0, ["a6", "a7"], None),  # as large as the noise pattern, which comes later
        ("a", 3, -1, "POLICY_VIOLATION", 2, 25.0, ["a2", "a8"], "noise"),
        ("a", 4, -1, "WRONG_ANSWER", 1, 12.5, ["a5"], "noise"),
        ("b", 1, None, "CONTEXT_LOSS", 2, 66.7, ["b1", "b3"], "context_loss"),
        ("b", 2, None, "WRONG_ANSWER", 1, 33.3, ["b2"], "unknown"),
    ]
    assert [r["evidence"] for r in rows] == [None, None, "2 individual failures of this type", "1 individual failures of this type", None, None]


def test_patterns_without_reply_text_or_rows(spark):
    table = spark.createDataFrame(ROWS, SCHEMA)
    bare = AN.failure_patterns(table.drop("actual_response").where("run_id = 'b'")).collect()
    assert sorted(r["scenario_count"] for r in bare) == [1, 2] and all(r["examples"] == [] for r in bare)
    assert AN.failure_patterns(table.limit(0)).count() == 0


def test_panel_assignment(spark):
    pool = [(S.FIXED_FIRST_JUDGE, "specialized", "standard"), ("o1", "openai", "frontier"), ("o2", "openai", "light"),
            ("a1", "anthropic", "standard"), ("g1", "google", "frontier")]
    tiers = {"frontier": 1, "standard": 2, "light": 3}
    targets = [(f"{f}-{t}-{i}", f, t) for f in ("openai", "anthropic", "google") for t in tiers for i in range(12)]
    table = spark.createDataFrame(targets, "target_id string, target_family string, target_tier string").withColumn(
        "excluded", F.array().cast("array<string>"))
    rows = J.assign_panels(table, pool, seed=7).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, J.assign_panels(table.repartition(5), pool, seed=7).collect()))
    seconds = set()
    for target, family, tier in targets:
        panel = {r["slot"]: r["model"] for r in rows if r["target_id"] == target}
        allowed = {m: tiers[t] for m, f, t in pool[1:] if f != family}
        strict = {m for m, t in allowed.items() if t <= tiers[tier]}
        assert panel[1] == S.FIXED_FIRST_JUDGE and sorted(panel) == list(range(1, 2 + min(2, len(allowed))))
        picked = [panel[s] for s in sorted(panel)[1:]]
        assert len(set(picked)) == len(picked) and set(picked) <= set(allowed)
        n = min(len(strict), len(picked))  # the tier rule is relaxed for what is left only
        assert set(picked[:n]) <= strict and not set(picked[n:]) & strict
        if family == "google" and tier == "light":
            seconds.add(picked[0])
    assert len(seconds) > 1  # the choice differs between targets
