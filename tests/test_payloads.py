"""Stored payloads of runs: decoding and the history that a run is told (SRC-05, SRC-07)."""

import datetime as dt
import json

from pyspark.sql import functions as F

from botqa.sources import runlog as RL


def _result(passed, kind=None, **more):
    return {"passed": passed, "failure_type": kind, "actual_response": "x", **more}


def _runs(spark, rows):
    return spark.createDataFrame([(r, c, s, dt.datetime(2024, 1, 1 + d), "RAG", None, p, None, None) for r, c, s, d, p in rows],
                                 "run_id string, company_name string, status string, created_at timestamp, system_type string, config_json string, "
                                 "results_json string, analysis_json string, fixes_json string")


def test_each_payload_has_its_own_shape(spark):
    runs = _runs(spark, [("a", "c", "completed", 0, '{"passed": 2, "results": [1, "x", {"deep": [null]}]}'), ("b", "c", "failed", 1, "{not json"),
                         ("c", "c", "failed", 2, ""), ("d", "c", "failed", 3, None), ("e", "c", "completed", 4, "[1, 2]")])
    runs = runs.withColumn("config_json", F.lit('{"max_scenarios": 5, "policies": {"refund_days": 30}}')).withColumn("fixes_json", F.lit("null"))
    rows = {r["run_id"]: r for r in RL.decode_payloads(runs).select(
        "run_id", "results_json", "results_undecodable", "analysis_undecodable", "fixes_undecodable",
        F.try_variant_get("config", "$.policies.refund_days", "int").alias("days"), F.try_variant_get("results", "$.passed", "int").alias("passed")).collect()}
    assert {k: r["results_undecodable"] for k, r in rows.items()} == {"a": False, "b": True, "c": False, "d": False, "e": False}
    assert rows["b"]["results_json"] == "{not json" and rows["b"]["days"] == 30 and rows["a"]["passed"] == 2 and rows["e"]["passed"] is None
    assert not any(r["analysis_undecodable"] or r["fixes_undecodable"] for r in rows.values())
    each = RL.items(RL.decode_payloads(runs), "results", "$.results")
    assert [(r["run_id"], r["pos"], json.loads(r["item"].toJson())) for r in each.orderBy("pos").select("run_id", "pos", "item").collect()] == [
        ("a", 0, 1), ("a", 1, "x"), ("a", 2, {"deep": [None]})]
    assert RL.items(RL.decode_payloads(runs), "config", "$.policies").count() == 0  # an object is not a list


def test_history_leaves_out_the_asking_run(spark):
    def stored(*results, **more):
        return json.dumps({"pass_rate": 0.5, "total_scenarios": len(results), "passed": 1, "failed": 1, "results": list(results), **more})

    rows = [("r1", "c", "completed", 1, stored(_result(False, "HALLUCINATION"), _result(False, "HALLUCINATION"), _result(True, "HALLUCINATION"))),
            ("r2", "c", "completed", 2, stored(_result(False, "INCOMPLETE"), _result(False), _result(False, ""), "odd")),
            ("r3", "c", "completed", 3, "cut off {"), ("r4", "c", "completed", 4, '{"results": 7}'), ("r5", "c", "failed", 5, stored(_result(False, "X"))),
            ("r6", "c", "completed", 6, stored(_result(False, "WRONG_ANSWER"))), ("r7", "c", "running", 7, None),
            ("q1", "d", "completed", 1, stored(_result(False, "INCOMPLETE")))]
    runs = _runs(spark, rows)
    asking = spark.createDataFrame([("c", "r7"), ("c", "r6"), ("c", "r1"), ("d", "q1"), ("none", "z")], "company_name string, run_id string")
    prior = RL.previous_runs(runs, asking, 4)
    told = {}
    for r in prior.orderBy("run_rank").collect():
        told.setdefault(r["asking_run"], []).append((r["run_id"], r["run_rank"], r["total_scenarios"], r["pass_rate"]))
    # r3 takes a place among the newest, but its text can't be read
    assert told == {"r7": [("r6", 1, 1, 0.5), ("r4", 2, 0, 0.0), ("r2", 4, 4, 0.5)], "r6": [("r4", 1, 0, 0.0), ("r2", 3, 4, 0.5), ("r1", 4, 3, 0.5)],
                    "r1": [("r6", 1, 1, 0.5), ("r4", 2, 0, 0.0), ("r2", 4, 4, 0.5)]}
    counted = {(r["asking_run"], r["run_id"], r["failure_type"]): r["n"] for r in RL.failure_breakdown(prior).collect()}
    assert counted == {("r7", "r6", "WRONG_ANSWER"): 1, ("r7", "r2", "INCOMPLETE"): 1, ("r6", "r2", "INCOMPLETE"): 1, ("r6", "r1", "HALLUCINATION"): 2,
                       ("r1", "r6", "WRONG_ANSWER"): 1, ("r1", "r2", "INCOMPLETE"): 1}
