"""Structured Streaming versions of the incremental operators (ST-01..ST-05).

Sinks are ``foreachBatch`` writers into Parquet folders keyed by the batch id
(a re-run of a batch overwrites its own partition, so retries after executor
loss are idempotent); ST-01, ST-03 and ST-05 merge their increments level by
level (``increments``), and the *view* of a sink reads the few widest folders.
Checkpoints live in the shared checkpoint folder.

* ST-01 episodic memory: stream of results joined to the static scenarios,
  per-batch (times, failures) increments; state = sum of increments.
* ST-02 regression library: per batch, first failing result per input
  (``min_by``) anti-joined against the buckets of the library that it falls into.
* ST-03 live run counters: streaming aggregate in update mode; view = latest
  value per run.
* ST-04 sticky persona status: running counts of each micro-batch with the
  counts of the state before it as offsets; a batch writes the state after it.
* ST-05 panel close: ``applyInPandasWithState`` keeps the votes of a panel until
  all its slots have voted or the watermark has passed its last vote by a day; the
  closed panels of a micro-batch then get their verdict.  Scenarios are hashed into
  buckets and a call steps all panels of a bucket at once, on whole columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import judge as J
from ..operators import learn as L
from ..session import cut_lineage
from ..sources.folders import exists
from .increments import compact, read_increments
from .sources import stream_workdir, written_batches

WATERMARK = "1 day"


def _write_increment(out_dir: str, merge):
    def sink(batch: DataFrame, batch_id: int) -> None:
        inc = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        inc.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
        compact(batch.sparkSession, out_dir, inc.schema, batch_id, merge)
    return sink


def _run(stream_df: DataFrame, job: str, sink_factory, output_mode: str = "append",
         trigger_once: bool = True, folder: str | None = None) -> str:
    spark = stream_df.sparkSession
    work = stream_workdir(spark, job, folder)
    out = f"{work}/out"
    w = (stream_df.writeStream.outputMode(output_mode)
         .option("checkpointLocation", f"{work}/checkpoint")
         .foreachBatch(sink_factory(out)))
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="10 seconds")
    q = w.start()
    if trigger_once:
        q.awaitTermination()
    return out


# ---------------------------------------------------------------------------
# ST-01
# ---------------------------------------------------------------------------
_MEMORY = ("system_hash string, pattern string, system_type string, times_used long, failures long, "
           "first_seq long, batch_id long")


def merge_memory(increments: DataFrame) -> DataFrame:
    return increments.groupBy("system_hash", "pattern", "system_type").agg(
        F.sum("times_used").alias("times_used"), F.sum("failures").alias("failures"),
        F.min("first_seq").alias("first_seq"), F.max("batch_id").alias("batch_id"))


def episodic_memory_stream(results_stream: DataFrame, scenarios: DataFrame, folder: str | None = None) -> DataFrame:
    """Per micro-batch (system, pattern) increments; returns the state view."""
    joined = L.join_results_scenarios(results_stream, scenarios)
    events = L.effectiveness_events(joined)

    def factory(out):
        def sink(batch, batch_id):
            inc = L.episodic_memory(batch).drop("failure_rate")
            _write_increment(out, merge_memory)(inc, batch_id)
        return sink

    out = _run(events, "episodic_memory", factory, folder=folder)
    held = read_increments(results_stream.sparkSession, out, _MEMORY, merge_memory)
    return held.drop("first_seq", "batch_id").withColumn("failure_rate", F.col("failures") / F.col("times_used"))


# ---------------------------------------------------------------------------
# ST-02
# ---------------------------------------------------------------------------
_LIBRARY = ("system_hash string, input string, expected_behavior string, difficulty string, "
            "tags array<string>, system_type string, seq long, bucket int, batch_id long")
#: Buckets of the library by (system, input); a batch writes a file for each that it touches.
LIBRARY_BUCKETS = 64


def regression_library_stream(results_stream: DataFrame, scenarios: DataFrame, folder: str | None = None) -> DataFrame:
    """ST-02.  The library lies in hash buckets of (system, input), and by batch inside
    a bucket.  A batch is first brought down to its first failure per input; then
    only the folders of the buckets that these fall into are listed, and only the
    two key columns of them read.  A batch that is run again replaces its own
    partitions with the same rows."""
    joined = L.join_results_scenarios(results_stream, scenarios)
    spark = results_stream.sparkSession

    def factory(out):
        def sink(batch, batch_id):
            bucket = F.pmod(F.xxhash64("system_hash", "input"), F.lit(LIBRARY_BUCKETS)).cast("int")
            new = cut_lineage(L.regression_candidates(batch).withColumn("bucket", bucket), "library_candidates")
            touched = [f"{out}/bucket={r['bucket']}" for r in new.select("bucket").distinct().collect()]  # LIBRARY_BUCKETS at most
            held = [p for p in touched if exists(spark, p)]
            if held:
                keys = (spark.read.schema(_LIBRARY).option("basePath", out).parquet(*held)
                        .where(F.col("batch_id") < batch_id).select("system_hash", "input", "bucket"))
                new = new.join(keys, ["system_hash", "input", "bucket"], "left_anti")
            (new.withColumn("batch_id", F.lit(batch_id).cast("bigint")).repartition("bucket").write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(out))
        return sink

    out = _run(joined, "regression_library", factory, folder=folder)
    if not exists(spark, out):
        return spark.createDataFrame([], _LIBRARY).drop("bucket")
    return spark.read.schema(_LIBRARY).parquet(out).drop("bucket")


# ---------------------------------------------------------------------------
# ST-03
# ---------------------------------------------------------------------------
_COUNTERS = "run_id string, total long, passed_count long, typed_failures long, batch_id long"


def merge_counters(increments: DataFrame) -> DataFrame:
    """The latest counters of each run."""
    latest = F.max_by(F.struct("total", "passed_count", "typed_failures"), "batch_id").alias("s")
    return increments.groupBy("run_id").agg(latest, F.max("batch_id").alias("batch_id")).select("run_id", "s.*", "batch_id")


def live_run_counters_stream(results_stream: DataFrame, folder: str | None = None) -> DataFrame:
    agg = results_stream.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("passed")).alias("passed_count"),
        F.count_if(~F.col("passed") & F.col("failure_type").isNotNull()).alias("typed_failures"))
    out = _run(agg, "live_run_counters", lambda out: _write_increment(out, merge_counters), output_mode="update", folder=folder)
    return read_increments(results_stream.sparkSession, out, _COUNTERS, merge_counters).drop("batch_id")


# ---------------------------------------------------------------------------
# ST-04
# ---------------------------------------------------------------------------
_PERSONA_STATE = "persona string, system_type string, times_used long, failures long, failure_discovery_rate double, status string"


def _snapshot(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The state that the last batch (before batch ``before``) has written."""
    found = [n for n in written_batches(spark, out) if before is None or n < before]
    if not found:
        return spark.createDataFrame([], _PERSONA_STATE)
    return spark.read.schema(_PERSONA_STATE).parquet(f"{out}/batch_id={max(found)}")


def persona_status_stream(uses_stream: DataFrame, folder: str | None = None) -> DataFrame:
    """ST-04: each batch goes on from the counts of the state before it, which are the
    offsets of its running counts (``persona_effectiveness``: a distributed prefix
    sum, so a persona with most of a batch's events is spread over tasks), and
    writes the state after it.  A batch that is run again finds the same state
    before it.  Uses count in the order of their batches, by ``ord`` inside one."""
    spark = uses_stream.sparkSession

    def factory(out):
        def sink(batch, batch_id):
            after = L.persona_effectiveness(batch, state=_snapshot(spark, out, batch_id))
            after.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        return sink

    out = _run(uses_stream, "persona_status", factory, folder=folder)
    return _snapshot(spark, out).drop("failure_discovery_rate")


# ---------------------------------------------------------------------------
# ST-05
# ---------------------------------------------------------------------------
_VOTES = "scenario_id long, slot int, passed boolean, failure_type string"
_PANEL_STATE = "panels binary"
PANEL_SLOTS = 3
PANEL_WAIT_MS = 24 * 3600 * 1000
#: Groups that the panels are hashed into; one call of the step takes all panels of a group.
PANEL_BUCKETS = 1024
_UNTIMED, _NEVER = -1, 1 << 62


def _panel_step(slots: int, wait_ms: int):
    """Votes of the open panels of a bucket (one per slot, the first holds) are kept as
    Arrow rows; a closed panel stays as a row without a vote until its time is up, so a
    repeated vote does not open it again.  The bucket's time is that of its first panel."""
    def held(state: GroupState) -> pd.DataFrame:
        if not state.exists:
            return pd.DataFrame({"scenario_id": np.zeros(0, np.int64), "slot": np.zeros(0, np.int64), "passed": np.zeros(0, bool),
                                 "failure_type": np.zeros(0, object), "last": np.zeros(0, np.int64), "due": np.zeros(0, np.int64), "closed": np.zeros(0, bool)})
        return pa.ipc.open_stream(bytes(state.get[0])).read_all().to_pandas()

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, old = state.getCurrentWatermarkMs(), held(state)
        new = old.iloc[:0] if state.hasTimedOut else pd.concat(list(pdfs), ignore_index=True)
        votes = pd.concat([old[["scenario_id", "slot", "passed", "failure_type"]], pd.DataFrame({
            "scenario_id": new["scenario_id"].astype("int64"), "slot": new["slot"].astype("int64"),
            "passed": new["passed"].fillna(False).astype(bool), "failure_type": new["failure_type"]})], ignore_index=True)
        code, _ = pd.factorize(votes["scenario_id"])
        panels, before = int(code.max(initial=-1)) + 1, code[:len(old)]
        closed, touched = np.zeros(panels, bool), np.zeros(panels, bool)
        last, due = np.full(panels, _UNTIMED), np.zeros(panels, np.int64)
        closed[before], last[before], due[before] = old["closed"], old["last"], old["due"]
        touched[code[len(old):]] = True
        if len(new):
            np.maximum.at(last, code[len(old):], new["ms"].fillna(_UNTIMED).to_numpy(np.int64))
        # a row of a closed panel, held or new, is no vote
        votes = votes.assign(code=code)[~closed[code]].drop_duplicates(["code", "slot"])
        full = np.bincount(votes["code"], minlength=panels) == slots
        due = np.where(touched, np.maximum(last + wait_ms, now + 1), due)
        due[touched & (last == _UNTIMED) & ~closed & ~full] = _NEVER
        gone = ~touched & (due < now)
        out = votes[(full | gone)[votes["code"]]].sort_values(["code", "slot"])
        if len(out):
            ids = pd.Series([None] * len(out), dtype=object) if key[0] < 0 else out["scenario_id"].to_numpy()
            yield pd.DataFrame({"scenario_id": ids, **{c: out[c].to_numpy() for c in ("slot", "passed", "failure_type")}})
        closed |= full
        stay = votes[~(closed | gone)[votes["code"]]]
        marks = np.flatnonzero(closed & ~gone)
        which = np.concatenate([stay["code"].to_numpy(np.int64), marks])
        if not len(which):
            if state.exists:
                state.remove()
            return
        ids = np.zeros(panels, np.int64)
        ids[code] = np.concatenate([old["scenario_id"], new["scenario_id"]]).astype(np.int64)
        kept = pa.table({"scenario_id": ids[which], "slot": np.concatenate([stay["slot"], np.zeros(len(marks))]).astype(np.int64),
                         "passed": np.concatenate([stay["passed"], np.zeros(len(marks))]).astype(bool),
                         "failure_type": pa.array([*stay["failure_type"], *[None] * len(marks)], pa.string(), from_pandas=True),
                         "last": last[which], "due": due[which], "closed": closed[which]})
        into = pa.BufferOutputStream()
        with pa.ipc.new_stream(into, kept.schema) as writer:
            writer.write_table(kept)
        state.update((into.getvalue().to_pybytes(),))
        state.setTimeoutTimestamp(max(int(due[which].min()), now))
    return step


def merge_panels(increments: DataFrame) -> DataFrame:
    """A panel closes once, so its verdicts are only put into fewer files."""
    return increments.hint("rebalance")


def panel_close_stream(verdicts_stream: DataFrame, slots: int = PANEL_SLOTS, wait_ms: int = PANEL_WAIT_MS,
                       folder: str | None = None) -> DataFrame:
    """One verdict per scenario, given when ``slots`` judges have voted or
    ``wait_ms`` after its last vote, by the watermark."""
    none = F.col("scenario_id").isNull()      # these are one panel, with a bucket of its own
    bucket = F.when(none, -1).otherwise(F.pmod(F.xxhash64("scenario_id"), F.lit(PANEL_BUCKETS))).cast("int")
    v = (verdicts_stream.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", WATERMARK)
         .select(bucket.alias("bucket"), F.when(none, 0).otherwise(F.col("scenario_id")).cast("bigint").alias("scenario_id"),
                 "slot", "passed", "failure_type", "created_at", F.unix_millis("created_at").alias("ms")))
    votes = v.groupBy("bucket").applyInPandasWithState(
        _panel_step(slots, wait_ms), _VOTES, _PANEL_STATE, "append", GroupStateTimeout.EventTimeTimeout)

    def factory(out):
        def sink(batch, batch_id):
            _write_increment(out, merge_panels)(J.panel_verdict(batch), batch_id)
        return sink

    out = _run(votes, "panel_close", factory, folder=folder)
    spark = verdicts_stream.sparkSession
    schema = J.panel_verdict(spark.createDataFrame([], _VOTES)).schema.add("batch_id", "long")
    return read_increments(spark, out, schema, lambda panels: panels)
