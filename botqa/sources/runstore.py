"""The run log in files: numbered appends and a bucketed snapshot of what they come to (SRC-01, SRC-03, SRC-04).

``<path>/events/append=<n>/bucket=<b>`` holds the events of append n, by hash of
``run_id``.  ``fold_run_events`` merges the appends that no snapshot holds yet into
the buckets that they touch and writes these as ``<path>/snapshot/upto=<n>/bucket=<b>``;
other buckets stay in the snapshot that wrote them last.  The state of a bucket is its
newest complete snapshot and the appends after it.

A snapshot row keeps, per column, the latest value with the ``(event_ts, seq)`` that
set it.  Taking the greatest of these is associative, commutative and idempotent, so
appends may hold events out of order, and merging one twice changes nothing.  A folder
whose job did not commit counts as absent: a failed append or fold leaves the state
before it readable, and running it again overwrites what it left.

Appends are numbered from 0 without gaps by whoever calls; writing a number again
replaces that append, which only makes sense until it is folded.  One fold runs at a
time.  Superseded snapshots and folded appends stay until the folder is cleared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folders import complete, numbers
from .runlog import RUN_COLUMNS, RUN_EVENT_SCHEMA

#: Buckets by hash of ``run_id``; fixed for the life of a store.
RUN_BUCKETS = 64

_EVENTS = T.StructType([*RUN_EVENT_SCHEMA.fields, T.StructField("append", T.LongType()), T.StructField("bucket", T.IntegerType())])


def _latest(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("event_ts", T.TimestampType()), T.StructField("seq", T.LongType()), T.StructField("value", kind)])


_STATE = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("bucket", T.IntegerType()),
                       T.StructField("upserted", T.BooleanType()), T.StructField("deleted", T.BooleanType()),
                       *[T.StructField(c, _latest(RUN_EVENT_SCHEMA[c].dataType)) for c in RUN_COLUMNS]])


def _bucket(run_id):
    return F.pmod(F.xxhash64(run_id), F.lit(RUN_BUCKETS)).cast("int")


def _as_state(events: DataFrame) -> DataFrame:
    """Each event as the state that it alone comes to."""
    upsert = F.col("op") == "upsert"
    sets = [F.when(upsert & F.col(c).isNotNull(), F.struct("event_ts", "seq", F.col(c).alias("value"))).alias(c) for c in RUN_COLUMNS]
    return events.select("run_id", "bucket", upsert.alias("upserted"), (F.col("op") == "delete").alias("deleted"), *sets)


def _merged(states: DataFrame) -> DataFrame:
    """One row per run; of a deleted run only the mark is kept."""
    deleted = F.bool_or("deleted")
    kept = [F.when(~F.coalesce(deleted, F.lit(False)), F.max(c)).alias(c) for c in RUN_COLUMNS]
    return states.groupBy("run_id", "bucket").agg(F.bool_or("upserted").alias("upserted"), deleted.alias("deleted"), *kept)


def append_run_events(events: DataFrame, path: str, number: int) -> None:
    """Write ``events`` as append ``number``.  A run with most of the events is split over files."""
    (events.select(*RUN_EVENT_SCHEMA.fieldNames(), _bucket("run_id").alias("bucket")).hint("rebalance", F.col("bucket"))
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/events/append={number}"))


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete snapshots, newest first."""
    return [n for n in reversed(numbers(spark, f"{path}/snapshot", "upto")) if complete(spark, f"{path}/snapshot/upto={n}")]


def _appends(spark: SparkSession, path: str, after: int) -> list[int]:
    return [n for n in numbers(spark, f"{path}/events", "append") if n > after and complete(spark, f"{path}/events/append={n}")]


def _newest(spark: SparkSession, path: str, snapshots: list[int], wanted: set[int]) -> dict[int, int]:
    """For each wanted bucket that any snapshot holds, the newest of them (a listing of folders, no data)."""
    found: dict[int, int] = {}
    for n in snapshots:
        if wanted <= found.keys():
            break
        found |= {b: n for b in numbers(spark, f"{path}/snapshot/upto={n}", "bucket") if b in wanted and b not in found}
    return found


def _held(spark: SparkSession, path: str, newest: dict[int, int]) -> DataFrame:
    if not newest:
        return spark.createDataFrame([], _STATE)
    folders = [f"{path}/snapshot/upto={n}/bucket={b}" for b, n in sorted(newest.items())]
    return spark.read.schema(_STATE).option("basePath", f"{path}/snapshot").parquet(*folders).select(*_STATE.fieldNames())


def _tail(spark: SparkSession, path: str, appends: list[int], wanted: set[int]) -> DataFrame:
    """Events of some appends, of the wanted buckets only."""
    folders = [f"{path}/events/append={n}/bucket={b}" for n in appends
               for b in numbers(spark, f"{path}/events/append={n}", "bucket") if b in wanted]
    if not folders:
        return spark.createDataFrame([], _EVENTS)
    return spark.read.schema(_EVENTS).option("basePath", f"{path}/events").parquet(*folders)


def fold_run_events(spark: SparkSession, path: str) -> int | None:
    """Bring the snapshot up to the last append before a gap; the number of that, or
    None if there was nothing to fold.  Only buckets with new events are read and written."""
    snapshots = _snapshots(spark, path)
    base = max(snapshots, default=-1)
    appends = [n for i, n in enumerate(_appends(spark, path, base)) if n == base + 1 + i]
    if not appends:
        return None
    touched = {b for n in appends for b in numbers(spark, f"{path}/events/append={n}", "bucket")}
    held = _held(spark, path, _newest(spark, path, snapshots, touched))
    state = _merged(held.unionByName(_as_state(_tail(spark, path, appends, touched))))
    (state.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket")
     .parquet(f"{path}/snapshot/upto={appends[-1]}"))
    return appends[-1]


def read_runs(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The live runs (``run_id`` and the run columns), as ``current_runs`` of all events
    ever appended.  For one ``run_id`` only its bucket is listed and read."""
    wanted = set(range(RUN_BUCKETS))
    if run_id is not None:
        wanted = {spark.range(1).select(_bucket(F.lit(run_id))).first()[0]}
    snapshots = _snapshots(spark, path)
    states = _held(spark, path, _newest(spark, path, snapshots, wanted)).unionByName(
        _as_state(_tail(spark, path, _appends(spark, path, max(snapshots, default=-1)), wanted)))
    states = states if run_id is None else states.where(F.col("run_id") == run_id)
    return (_merged(states).where("upserted and not deleted")
            .select("run_id", *[F.col(f"{c}.value").alias(c) for c in RUN_COLUMNS]))
