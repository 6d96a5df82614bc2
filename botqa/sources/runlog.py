"""Run log as an append-only event table (SRC-03..SRC-07, W-03, W-04); ``runstore`` keeps it in files.

Instead of UPDATE/DELETE on one table, every change is an event row
``run_events(run_id, event_ts, seq, op, <nullable run columns>)``; the current
state of all runs is one aggregate over the log (latest non-null value per
column), deletes are tombstones removed with an anti-join.  Parquet append
logs need no table format and the state rebuild is a single hash aggregate
keyed by run_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a run.
RUN_COLUMNS = ["created_at", "company_name", "system_type", "target_model", "status", "pass_rate",
               "total_scenarios", "total_failures", "run_cost_usd", "config_json", "results_json",
               "analysis_json", "fixes_json", "error_message"]

RUN_EVENT_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("event_ts", T.TimestampType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("op", T.StringType(), False),          # 'upsert' | 'delete'
    T.StructField("created_at", T.TimestampType()),
    T.StructField("company_name", T.StringType()),
    T.StructField("system_type", T.StringType()),
    T.StructField("target_model", T.StringType()),
    T.StructField("status", T.StringType()),             # running | completed | failed
    T.StructField("pass_rate", T.DoubleType()),
    T.StructField("total_scenarios", T.LongType()),
    T.StructField("total_failures", T.LongType()),
    T.StructField("run_cost_usd", T.DoubleType()),
    T.StructField("config_json", T.StringType()),
    T.StructField("results_json", T.StringType()),
    T.StructField("analysis_json", T.StringType()),
    T.StructField("fixes_json", T.StringType()),
    T.StructField("error_message", T.StringType()),
])

#: The columns that hold JSON text.
PAYLOADS = ("config", "results", "analysis", "fixes")


def current_runs(events: DataFrame) -> DataFrame:
    """SRC-03 + SRC-04: state of every run = per column the value of the
    latest event that set it (non-null); runs with a delete tombstone are
    dropped.  One hash aggregate on run_id."""
    order, upsert = F.struct("event_ts", "seq"), F.col("op") == "upsert"
    aggs = [F.max_by(c, F.when(upsert & F.col(c).isNotNull(), order)).alias(c) for c in RUN_COLUMNS
            if c in events.columns]
    state = events.groupBy("run_id").agg(*aggs, F.count_if(upsert).alias("_upserts"),
                                         F.count_if(F.col("op") == "delete").alias("_deletes"))
    return state.where("_upserts > 0 and _deletes = 0").drop("_upserts", "_deletes")


def decode_payloads(runs: DataFrame, payloads: tuple[str, ...] = PAYLOADS) -> DataFrame:
    """SRC-05: each JSON column as a variant of its own shape (``config``, ``results``,
    ``analysis``, ``fixes``).  The text stays beside it; text that is not JSON has a
    null variant and ``<name>_undecodable`` set.  Empty text counts as no payload."""
    return runs.withColumns({k: v for p in payloads for k, v in {
        p: F.try_parse_json(f"{p}_json"),
        f"{p}_undecodable": F.coalesce(F.col(f"{p}_json") != "", F.lit(False)) & F.try_parse_json(f"{p}_json").isNull()}.items()})


def items(decoded: DataFrame, payload: str, path: str) -> DataFrame:
    """One row per element of a list inside a payload (``pos``, ``item``); runs
    without the payload or the list have none."""
    listed = decoded.withColumn("_items", F.try_variant_get(payload, path, "variant"))
    each = decoded.sparkSession.tvf.variant_explode(F.col("_items").outer()).select("pos", F.col("value").alias("item"))
    # an object would be exploded by its keys
    lists = listed.where(F.schema_of_variant("_items").startswith("ARRAY"))
    return lists.lateralJoin(each).drop("_items")


def list_runs(runs: DataFrame, limit: int = 100) -> DataFrame:
    """SRC-06: 10 summary columns, newest first, at most ``limit`` (TakeOrdered)."""
    cols = ["run_id", "company_name", "system_type", "status", "pass_rate", "total_scenarios",
            "total_failures", "run_cost_usd", "created_at", "error_message"]
    return runs.select(*cols).orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def newest_per_key(df: DataFrame, key: str, n: int, order_col: str = "created_at") -> DataFrame:
    """W-04 (and W-03 with n=1): the n newest rows per key; ``run_rank`` 1 = newest.
    ``row_number() <= n`` plans a partial WindowGroupLimit before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(order_col), F.desc("run_id"))
    return df.withColumn("run_rank", F.row_number().over(w)).where(F.col("run_rank") <= n)


def latest_run(df: DataFrame, key: str, order_col: str = "created_at") -> DataFrame:
    """W-03: the latest run per key as one aggregate (``max_by``), no window."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(order_col, "run_id")).alias("r")) \
        .select(key, "r.*")


def previous_runs(runs: DataFrame, asking: DataFrame, limit: int = 5) -> DataFrame:
    """SRC-07: for each asking run (``company_name``, ``run_id``) the ``limit`` newest
    completed runs of its company but itself, with the counts that their results
    payload holds; runs whose payload is missing or undecodable are left out after
    the cut.  ``run_rank`` 1 is the newest.

    Each company's ``limit`` + 1 newest runs are cut first (``newest_per_key``), so
    the join with the asking runs is small whatever a company has stored."""
    asks = asking.select("company_name", F.col("run_id").alias("asking_run"))
    newest = newest_per_key(runs.where(F.col("status") == "completed"), "company_name", limit + 1)
    # one that asks takes a place of its own among the newest, or none
    own = newest.select(F.col("run_id").alias("asking_run"), F.col("run_rank").alias("own_rank"))
    prior = (asks.join(own, "asking_run", "left").join(newest, "company_name")
             .where(F.col("run_id") != F.col("asking_run"))
             .withColumn("run_rank", F.col("run_rank") - F.when(F.col("own_rank") < F.col("run_rank"), 1).otherwise(0))
             .where(F.col("run_rank") <= limit).drop("own_rank"))
    prior = decode_payloads(prior, ("results",)).where("results is not null")
    number = {"total_scenarios": "bigint", "passed": "bigint", "failed": "bigint", "pass_rate": "double"}
    return prior.select("company_name", "asking_run", "run_id", "run_rank", "created_at", F.coalesce("system_type", F.lit("CUSTOMER_SUPPORT")).alias("system_type"),
                        *[F.coalesce(F.try_variant_get("results", f"$.{c}", t), F.lit(0).cast(t)).alias(c) for c, t in number.items()], "results")


def failure_breakdown(prior: DataFrame) -> DataFrame:
    """SRC-07: failed, typed results of each previous run, counted again from the
    ``results`` list of its payload: company_name, asking_run, run_id, run_rank, failure_type, n."""
    each = items(prior, "results", "$.results")
    kind = F.try_variant_get("item", "$.failure_type", "string")
    failed = ~F.coalesce(F.try_variant_get("item", "$.passed", "boolean"), F.lit(False))
    return (each.select("company_name", "asking_run", "run_id", "run_rank", kind.alias("failure_type"), failed.alias("failed"))
            .where("failed and failure_type <> ''").groupBy("company_name", "asking_run", "run_id", "run_rank", "failure_type")
            .agg(F.count("*").alias("n")))
