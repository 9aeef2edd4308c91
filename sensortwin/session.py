"""Session construction and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import SparkSession

# Session settings every entry point relies on: UTC so date/hour/bucket values do not
# depend on the machine, AQE for runtime coalescing, skew splitting and broadcast
# conversion based on *measured* shuffle sizes.  Static (estimate-based) broadcast is
# off: a join side is broadcast only after AQE has measured it below the threshold.
BROADCAST_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
}
BASE_CONF = {
    **BROADCAST_CONF,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "sensortwin", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def apply_session_defaults(spark: SparkSession) -> SparkSession:
    """Pin the one setting results depend on (the time zone) on an existing session.  All other
    settings stay the caller's; adaptive execution being off is only warned about."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get("spark.sql.adaptive.enabled", "true") != "true":
        warnings.warn("adaptive execution is off: skewed joins and small partitions are not handled", stacklevel=2)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (on a cluster this names shared
    storage).  Where it is unset, a local master (tests, benches) gets a fresh local folder;
    any other master is refused, as executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="sensortwin-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path below the shared checkpoint folder."""
    root = checkpoint_root(spark)
    sep = "" if root.endswith("/") else "/"
    return f"{root}{sep}{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme (tests write hand-made fixture files with plain Python)."""
    return path[5:] if path.startswith("file:") else path

