"""Structured Streaming semantics not visible in the batch oracles: late data
and micro-batch increments."""

import datetime as dt
import os
import random
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from botqa.operators import learn as L
from botqa.streaming import jobs as SJ


def _write(spark, rows, folder, name, mtime=None):
    df = spark.createDataFrame(rows, "scenario_id long, slot int, passed boolean, failure_type string, "
                                     "confidence double, created_at timestamp")
    df.coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, name))
    _touch(os.path.join(folder, name), mtime)


def _touch(path, mtime):
    """File streams take files in modification-time order: make arrival order explicit."""
    if mtime is None:
        return
    for f in os.listdir(path):
        os.utime(os.path.join(path, f), (mtime, mtime))


def test_panel_closes_when_all_slots_voted_or_its_time_is_up(spark):
    """One verdict per panel: at the last slot's vote, even if the votes fall on two
    days and one is repeated; without all slots, a day after the last vote by the
    watermark; a panel whose time is not up stays open."""
    base = tempfile.mkdtemp(prefix="botqa-stream-", dir="/tmp")
    src = os.path.join(base, "verdicts")
    os.makedirs(src)
    d0 = dt.datetime(2024, 1, 1, 22, 0)
    hour = dt.timedelta(hours=1)
    _write(spark, [(1, 0, False, "HALLUCINATION", 0.9, d0), (1, 1, False, "HALLUCINATION", 0.8, d0),
                   (4, 0, False, "INCOMPLETE", 0.9, d0), (4, 1, False, None, 0.9, d0)], src, "b1", 1_000_000_000)
    schema = spark.read.parquet(os.path.join(src, "b1")).schema
    _write(spark, [(1, 2, True, None, 0.9, d0 + 4 * hour)], src, "b2", 1_000_000_100)
    _write(spark, [(1, 2, True, None, 0.9, d0 + 5 * hour), (2, 0, True, None, 0.9, d0 + 72 * hour)], src, "b3", 1_000_000_200)
    _write(spark, [(3, 0, False, "WRONG_ANSWER", 0.9, d0 + 73 * hour)], src, "b4", 1_000_000_300)
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out = {r.scenario_id: r for r in SJ.panel_close_stream(stream).collect()}
    assert sorted(out) == [1, 4]                            # 2 and 3 are still open
    p = out[1]
    assert (p.pass_votes, p.fail_votes, p.passed, p.agreement_level) == (1, 2, False, "majority")
    assert p.failure_type == "HALLUCINATION"
    q = out[4]
    assert (q.pass_votes, q.fail_votes, q.agreement_level, q.failure_type) == (0, 2, "unanimous", "INCOMPLETE")
    assert p.batch_id < q.batch_id


def test_live_counters_accumulate_across_batches(spark):
    base = tempfile.mkdtemp(prefix="botqa-stream-", dir="/tmp")
    src = os.path.join(base, "results")
    os.makedirs(src)
    rows1 = [("r1", True, None), ("r1", False, "HALLUCINATION"), ("r2", True, None)]
    rows2 = [("r1", False, None), ("r2", False, "WRONG_ANSWER")]
    for i, rows in enumerate((rows1, rows2)):
        spark.createDataFrame(rows, "run_id string, passed boolean, failure_type string") \
            .coalesce(1).write.parquet(os.path.join(src, f"b{i}"))
        _touch(os.path.join(src, f"b{i}"), 1_000_000_000 + 100 * i)
    schema = spark.read.parquet(os.path.join(src, "b0")).schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    got = {r.run_id: (r.total, r.passed_count, r.typed_failures)
           for r in SJ.live_run_counters_stream(stream).collect()}
    assert got == {"r1": (3, 1, 1), "r2": (2, 1, 1)}


def _results(spark, src, i, rows):
    spark.createDataFrame(rows, "result_id long, scenario_id long, run_id string, passed boolean, failure_type string, created_at timestamp") \
        .coalesce(1).write.parquet(os.path.join(src, f"b{i}"))
    _touch(os.path.join(src, f"b{i}"), 1_000_000_000 + 100 * i)


def _stream(spark, src):
    schema = spark.read.parquet(os.path.join(src, "b0")).schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(src).withColumn("seq", F.col("result_id")))


def test_stopped_jobs_go_on_where_they_were(spark, tmp_path):
    """A job launched again on its folder equals one run over all batches, and an
    input that the library already has is not added again."""
    day = dt.datetime(2024, 1, 1)
    scenarios = spark.createDataFrame([(i, "c", "RAG", f"in {i % 2}", f"out {i}", "EASY", "h") for i in range(6)],
                                      "scenario_id long, company string, system_type string, input string, expected_behavior string, "
                                      "difficulty string, system_hash string").withColumn("tags", F.array(F.lit("t")))
    batches = [[(0, 0, "r", False, "HALLUCINATION", day), (1, 1, "r", True, None, day)],
               [(2, 2, "r", False, "INCOMPLETE", day), (3, 3, "q", False, "WRONG_ANSWER", day)],
               [(4, 4, "r", False, "INCOMPLETE", day), (5, 5, "r", False, "INCOMPLETE", day)]]
    src, folder = str(tmp_path / "src"), str(tmp_path / "job")
    os.makedirs(src)
    for i, rows in enumerate(batches):
        _results(spark, src, i, rows)
        library = SJ.regression_library_stream(_stream(spark, src), scenarios, folder=folder)
        counters = SJ.live_run_counters_stream(_stream(spark, src), folder=folder)
    one_library = SJ.regression_library_stream(_stream(spark, src), scenarios).drop("batch_id")
    one = SJ.live_run_counters_stream(_stream(spark, src))
    assert sorted(map(str, counters.collect())) == sorted(map(str, one.collect()))
    assert sorted(map(str, library.drop("batch_id").collect())) == sorted(map(str, one_library.collect()))
    assert sorted((r.input, r.seq) for r in library.collect()) == [("in 0", 0), ("in 1", 3)]
    assert len({r.batch_id for r in library.collect()}) == 2


def _uses(spark, src, i, rows):
    spark.createDataFrame(rows, "ord long, persona string, system_type string, found_failure boolean").coalesce(1).write.parquet(os.path.join(src, f"b{i}"))
    _touch(os.path.join(src, f"b{i}"), 1_000_000_000 + 100 * i)


def _uses_stream(spark, src):
    schema = spark.read.parquet(os.path.join(src, "b0")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)


def test_persona_status_of_several_batches(spark, tmp_path):
    """One persona has a third of all uses; stops, restarts and a batch run again equal the batch query."""
    rng, src, folder = random.Random(8), str(tmp_path / "src"), str(tmp_path / "job")
    os.makedirs(src)
    who = ["hot" if i % 3 == 0 else f"p{rng.randint(0, 9)}" for i in range(1500)]
    rows = [(i, p, "RAG", rng.random() < (0.3 if p == "hot" else int(p[1:]) / 12) * (0.1 if i < 600 else 1)) for i, p in enumerate(who)]
    for i in range(3):
        _uses(spark, src, i, rows[500 * i:500 * i + 500])
        got = SJ.persona_status_stream(_uses_stream(spark, src), folder=folder)
    want = L.persona_effectiveness(spark.createDataFrame(rows, "ord long, persona string, system_type string, found_failure boolean")).drop("failure_discovery_rate")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len({r.status for r in want.collect()}) > 1
    out = f"{folder}/persona_status/out"
    assert sorted(SJ.written_batches(spark, out)) == [0, 1, 2]
    last = spark.createDataFrame(rows[1000:], "ord long, persona string, system_type string, found_failure boolean")
    again = L.persona_effectiveness(last, bucket_width=64, state=SJ._snapshot(spark, out, 2)).drop("failure_discovery_rate")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, want.collect()))


def test_a_batch_reads_only_the_buckets_it_falls_into(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    scenarios = spark.createDataFrame([(i, "c", "RAG", f"in {i}", "out", "EASY", "h") for i in range(80)],
                                      "scenario_id long, company string, system_type string, input string, expected_behavior string, "
                                      "difficulty string, system_hash string").withColumn("tags", F.array(F.lit("t")))
    src, folder = str(tmp_path / "src"), str(tmp_path / "job")
    os.makedirs(src)
    _results(spark, src, 0, [(i, i, "r", False, "INCOMPLETE", day) for i in range(78)])
    SJ.regression_library_stream(_stream(spark, src), scenarios, folder=folder)
    out = f"{folder}/regression_library/out"
    spread = [d for d in os.listdir(out) if d.startswith("bucket=")]
    assert 30 < len(spread) <= SJ.LIBRARY_BUCKETS
    mine = {r[0] for r in spark.createDataFrame([("h", "in 3"), ("h", "in 79")], "system_hash string, input string").select(
        F.pmod(F.xxhash64("system_hash", "input"), F.lit(SJ.LIBRARY_BUCKETS))).collect()}
    for d in spread:  # a file that can't be read, in every other bucket
        if int(d.partition("=")[2]) not in mine:
            os.makedirs(f"{out}/{d}/batch_id=0", exist_ok=True)
            with open(f"{out}/{d}/batch_id=0/broken.parquet", "w") as f:
                f.write("not parquet")
    _results(spark, src, 1, [(100, 3, "r", False, "INCOMPLETE", day), (101, 79, "r", False, "INCOMPLETE", day), (102, 79, "r", False, "INCOMPLETE", day)])
    SJ.regression_library_stream(_stream(spark, src), scenarios, folder=folder)
    new = spark.read.option("basePath", out).parquet(*[f"{out}/bucket={b}" for b in mine]).where("batch_id = 1").collect()
    assert [(r.input, r.seq) for r in new] == [("in 79", 101)]


class _BucketState:
    """Stands in for the state of one bucket of panels."""

    def __init__(self):
        self.value, self.due, self.watermark, self.hasTimedOut = None, None, 0, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, ms):
        assert ms >= self.watermark
        self.due = ms


def test_a_bucket_of_panels_steps_like_its_panels_one_by_one():
    """All panels of a bucket in one call per batch, against plain Python by panel:
    votes repeated and late, panels that close, time out, or get votes once closed."""
    rng, wait, slots = random.Random(4), 50, 3
    step, state = SJ._panel_step(slots, wait), _BucketState()
    votes, last, due, closed, watermark, total = {}, {}, {}, set(), 0, 0
    for batch in range(40):
        rows = [(rng.randrange(300), rng.randrange(slots), rng.random() < 0.5, rng.choice(["HALLUCINATION", None]), 30 * batch + rng.randrange(60))
                for _ in range(rng.randrange(60) if batch < 35 else 0)]
        state.watermark, expected = watermark, []
        for panel, slot, passed, kind, ms in rows:
            last[panel] = max(last.get(panel, 0), ms)
            if panel not in closed:
                votes.setdefault(panel, {}).setdefault(slot, (passed, kind))
        touched = {r[0] for r in rows}
        for panel in touched:
            due[panel] = max(last[panel] + wait, watermark + 1)
            if panel not in closed and len(votes[panel]) == slots:
                closed.add(panel)
                expected += [(panel, s, *v) for s, v in votes.pop(panel).items()]
        for panel in [p for p in due if p not in touched and due[p] < watermark]:
            expected += [(panel, s, *v) for s, v in votes.pop(panel, {}).items()]
            closed.discard(panel)
            del due[panel], last[panel]
        state.hasTimedOut = not rows and state.exists and state.due < watermark
        got = []
        if rows or state.hasTimedOut:
            pdf = pd.DataFrame(rows, columns=["scenario_id", "slot", "passed", "failure_type", "ms"])
            for out in step((7,), iter([pdf[:10], pdf[10:]] if rows else []), state):
                got += [(r.scenario_id, r.slot, r.passed, r.failure_type) for r in out.itertuples()]
        assert sorted(got, key=str) == sorted(expected, key=str)
        total += len(got)
        watermark = max([watermark, *(r[4] - 20 for r in rows)]) if batch < 35 else watermark + 40
    assert total > 300 and not state.exists


def test_votes_without_a_time_or_a_scenario(spark, tmp_path):
    """A panel is complete without any time given; one that is not stays open. Votes without a scenario are one panel."""
    day, src = dt.datetime(2024, 1, 1), str(tmp_path)
    _write(spark, [(1, s, True, None, 0.9, None) for s in range(3)] + [(2, 0, True, None, 0.9, None)]
           + [(None, s, False, "INCOMPLETE", 0.9, day) for s in range(3)], src, "b1", 1_000_000_000)
    _write(spark, [(3, 0, True, None, 0.9, day + dt.timedelta(days=9))], src, "b2", 1_000_000_100)
    schema = spark.read.parquet(os.path.join(src, "b1")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    out = {r.scenario_id: (r.pass_votes, r.fail_votes) for r in SJ.panel_close_stream(stream).collect()}
    assert out == {1: (3, 0), None: (0, 3)}
