"""Session construction and the shared scratch location.

The library never picks a machine-local folder on its own: lineage cuts and
materialised tables go under ``spark.checkpoint.dir`` as configured for the
cluster. Only on a local master (unit tests, a laptop) and without that setting
does ``store_root`` fall back to a fresh ``mkdtemp`` folder; on a cluster the
missing setting is an error.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

_FALLBACK_ROOT: str | None = None


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "airlens") -> SparkSession:
    """A session tuned for the catalog: AQE on, UTC clock, UI off.

    The master and the number of shuffle partitions are the caller's or the
    submit command's. Only a process started without a master (a laptop, the
    benchmark) runs on ``local[$BENCH_CPUS]``, with as many partitions as cores.
    """
    conf = SparkConf()
    builder = SparkSession.builder
    master = master or (None if conf.get("spark.master", None) else "local")
    if master:
        cpus = os.environ.get("BENCH_CPUS", "8")
        builder = builder.master(f"local[{cpus}]" if master == "local" else master)
        shuffle_partitions = shuffle_partitions or (int(cpus) if master.startswith("local") else None)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("AIRLENS_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; set a private one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        configured = _fallback_root(spark)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def store_root(spark: SparkSession) -> str:
    """Folder for tables the library materialises (shared on a cluster).

    It is the parent of the checkpoint directory Spark reports (Spark appends a
    per-application UUID), so materialised tables are reused across sessions.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        configured = os.path.dirname(ensure_checkpoint_dir(spark).rstrip("/"))
    return configured.rstrip("/") + "/airlens_store"


def _fallback_root(spark: SparkSession) -> str:
    """A folder of this machine, for a local master only."""
    global _FALLBACK_ROOT
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _FALLBACK_ROOT is None:
        _FALLBACK_ROOT = tempfile.mkdtemp(prefix="airlens-ckpt-")
    return _FALLBACK_ROOT
