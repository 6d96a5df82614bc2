"""SparkSession construction and cluster-facing settings.

On a cluster the session arrives already configured; ``get_session`` only fills
in what is unset, so a cluster's own values (shuffle partitions, checkpoint
dir, memory) always win.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins at runtime (broadcast when
# a side turns out small, split skewed partitions, coalesce tiny ones).
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "botqa") -> SparkSession:
    wanted = dict(_DEFAULTS)
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    wanted["spark.driver.memory"] = os.environ.get("BOTQA_DRIVER_MEMORY", "16g")
    if SparkContext._gateway or "PYSPARK_GATEWAY_PORT" in os.environ:  # spark-submit or a running session: its values win
        given = SparkConf()
        running = SparkSession.getActiveSession()
        wanted = {k: v for k, v in wanted.items() if not given.contains(k) and (running is None or running.conf.get(k, None) is None)}
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in wanted.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object-store) folder there and we use it as
    is.  A session that runs in one process may leave it unset and gets a scratch
    folder; any other must set it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf_dir:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="botqa-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf_dir) if _settable(spark) else None
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def _settable(spark: SparkSession) -> bool:
    try:
        return spark.conf.isModifiable("spark.checkpoint.dir")
    except Exception:  # pragma: no cover - older API
        return False


def cut_lineage(df: DataFrame, name: str = "t") -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    and continue from that table.

    The result has a fresh, one-node plan (a file scan): iterative jobs do not
    grow their plans round after round, and the data survives executor loss
    (it lives in the cluster's shared folder, never on an executor).
    """
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
