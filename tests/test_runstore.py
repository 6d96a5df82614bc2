"""The run log in files: appends, folds, restarts and what a reader sees."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from botqa.sources import runlog as RL
from botqa.sources import runstore as RS

T0 = dt.datetime(2024, 1, 1)
NAMES = RL.RUN_EVENT_SCHEMA.fieldNames()


def _event(run, seq, op="upsert", **given):
    row = dict.fromkeys(NAMES) | {"run_id": run, "event_ts": T0 + dt.timedelta(minutes=seq), "seq": seq, "op": op} | given
    return tuple(row[n] for n in NAMES)


def _df(spark, rows):
    return spark.createDataFrame(rows, RL.RUN_EVENT_SCHEMA)


def _rows(df):
    return sorted(map(str, df.select("run_id", *RL.RUN_COLUMNS).collect()))


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_state_after_appends_and_folds_equals_a_rebuild(spark, tmp_path):
    """Random partial updates and deletes, out of order and repeated, one run with
    a third of them; some appends folded together, some not at all."""
    rnd, path, everything = random.Random(7), str(tmp_path), []
    for number in range(8):
        rows = []
        for _ in range(60):
            run = "hot" if rnd.random() < 0.34 else f"r{rnd.randrange(40)}"
            given = {c: v for c, v in (("status", rnd.choice(["running", "completed"])), ("pass_rate", rnd.random()),
                                       ("company_name", f"c{rnd.randrange(5)}"), ("results_json", '{"a": "é"}')) if rnd.random() < 0.5}
            rows.append(_event(run, rnd.randrange(10_000), "delete" if run != "hot" and rnd.random() < 0.03 else "upsert", **given))
        if everything:
            rows += rnd.sample(everything, 5)
        if number == 4:
            rows = []
        everything += rows
        RS.append_run_events(_df(spark, rows), path, number)
        if number in (1, 2, 5):
            assert RS.fold_run_events(spark, path) == number
        want = _rows(RL.current_runs(_df(spark, everything)))
        assert _rows(RS.read_runs(spark, path)) == want
    assert any("hot" in r for r in want) and len(want) < 41
    assert _rows(RS.read_runs(spark, path, "hot")) == [r for r in want if "'hot'" in r]
    assert RS.fold_run_events(spark, path) == 7 and RS.fold_run_events(spark, path) is None
    assert _rows(RS.read_runs(spark, path)) == want


def test_a_fold_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path)
    RS.append_run_events(_df(spark, [_event(f"r{i}", i, status="running") for i in range(300)]), path, 0)
    RS.fold_run_events(spark, path)
    before = _files(f"{path}/snapshot")
    assert len(os.listdir(f"{path}/snapshot/upto=0")) > 50
    RS.append_run_events(_df(spark, [_event("r5", 900, status="completed"), _event("r6", 901, "delete")]), path, 1)
    RS.fold_run_events(spark, path)
    buckets = [d for d in os.listdir(f"{path}/snapshot/upto=1") if d.startswith("bucket=")]
    assert 1 <= len(buckets) <= 2
    after = _files(f"{path}/snapshot")
    assert before.items() <= after.items()
    got = {r.run_id: r.status for r in RS.read_runs(spark, path).collect()}
    assert len(got) == 299 and got["r5"] == "completed" and "r6" not in got
    one = RS.read_runs(spark, path, "r5")
    assert {f.split("/bucket=")[1].split("/")[0] for f in one.inputFiles()} == {str(spark.range(1).select(RS._bucket(F.lit("r5"))).first()[0])}


def _without_success(df, path):
    """What a job leaves that is lost before its commit has ended."""
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy("bucket").parquet(path)


def test_failed_appends_and_folds_leave_the_state_before(spark, tmp_path):
    path = str(tmp_path)
    first = [_event(f"r{i}", i, status="running") for i in range(20)]
    RS.append_run_events(_df(spark, first), path, 0)
    RS.fold_run_events(spark, path)
    RS.append_run_events(_df(spark, [_event("r1", 50, status="completed")]), path, 1)
    want = _rows(RS.read_runs(spark, path))
    # a fold that was lost: a folder with a part of the rows
    part = RS._as_state(_df(spark, first[:1]).withColumn("bucket", RS._bucket("run_id")))
    _without_success(part, f"{path}/snapshot/upto=1")
    # an append that was lost
    _without_success(_df(spark, [_event("r2", 60, status="failed")]).withColumn("bucket", RS._bucket("run_id")), f"{path}/events/append=2")
    assert _rows(RS.read_runs(spark, path)) == want
    # a later append is read, but not folded over the missing one
    RS.append_run_events(_df(spark, [_event("r3", 70, status="failed")]), path, 3)
    assert RS.fold_run_events(spark, path) == 1 and RS.fold_run_events(spark, path) is None
    got = {r.run_id: r.status for r in RS.read_runs(spark, path).collect()}
    assert got == {f"r{i}": "running" for i in range(20)} | {"r1": "completed", "r3": "failed"}
    RS.append_run_events(_df(spark, [_event("r2", 60, status="failed")]), path, 2)
    assert RS.fold_run_events(spark, path) == 3
    assert {r.run_id: r.status for r in RS.read_runs(spark, path).collect()} == got | {"r2": "failed"}


def test_an_empty_store(spark, tmp_path):
    assert RS.read_runs(spark, str(tmp_path / "none")).count() == 0
    assert RS.fold_run_events(spark, str(tmp_path / "none")) is None
    assert RS.read_runs(spark, str(tmp_path / "none"), "r").columns == ["run_id", *RL.RUN_COLUMNS]
