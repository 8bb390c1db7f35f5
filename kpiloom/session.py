"""Session construction and shared-storage helpers."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job in this package is written against.  AQE re-plans joins and
# aggregates from runtime sizes; skew handling splits a hot user's partition (one
# key may hold a third of all events or orders).  ``forceOptimizeSkewedJoin``
# lets AQE split a skewed join even when the aggregate right after it then needs
# an extra exchange, which is the shape of every per-user model here.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# Seconds between two collections of the driver's garbage in a long job of many small steps.
COLLECT_S = 20


def build_session(
    master: str | None = None,
    app_name: str = "kpiloom",
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the package defaults.

    ``master`` is set only when given (tests, the local bench): under
    ``spark-submit`` the launcher owns the master and resource settings, and a
    master set in code would override it.  This only adds the SQL settings the
    jobs rely on.
    """
    b = SparkSession.builder.appName(app_name)
    if master is not None:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when nothing is configured (local tests) a private scratch folder is
    created; on a cluster the configured shared folder is always used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: checkpoints and run "
                               "artifacts must survive the loss of an executor")
        configured = tempfile.mkdtemp(prefix="kpiloom-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def collect_garbage(spark: SparkSession) -> None:
    """A collection on the driver, as ``spark.cleaner.periodicGC.interval`` does every 30
    minutes and only a new session can change: Spark drops the shuffles and broadcasts of
    finished jobs when their handles are collected, and the heap shrinks back.  Python's
    own goes first: its cycles keep handles of the JVM's objects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def collecting(spark: SparkSession, seconds: float = COLLECT_S) -> Iterator[None]:
    """:func:`collect_garbage` every so many seconds, and at the end."""
    done = threading.Event()

    def collect():
        while not done.wait(seconds):
            collect_garbage(spark)

    thread = threading.Thread(target=collect, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
        collect_garbage(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "kpiloom", name)


def sizing_conf(input_bytes: int, target_partition_bytes: int = 128 << 20,
                min_partitions: int = 200, max_partitions: int = 100_000) -> dict:
    """Partition settings for a given input size.

    Scans split files into ``target_partition_bytes`` pieces; the first shuffle
    of each query starts with enough partitions that even an unaggregated
    shuffle of the whole input stays near that size per task, and AQE then
    coalesces partitions the aggregates made small.  At 100 TB this gives the
    maximum (100,000) initial partitions of ~1 GB of input each before partial
    aggregation, which the map-side combines shrink by orders of magnitude.
    """
    parts = max(min_partitions, min(max_partitions, -(-int(input_bytes) // target_partition_bytes)))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }


def input_bytes(spark: SparkSession, paths) -> int:
    """Total size of the given files or folders on their file system (a metadata
    call on the driver; no data is read)."""
    sc = spark.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        total += hp.getFileSystem(conf).getContentSummary(hp).getLength()
    return int(total)


def size_session(spark: SparkSession, paths, **kw) -> dict:
    """Apply :func:`sizing_conf` for the inputs at ``paths`` to the session."""
    conf = sizing_conf(input_bytes(spark, paths), **kw)
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
