"""Session helpers.

Library code never creates a session of its own; it takes the caller's. These
helpers are for tests, the bench and the CLI entry points.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading

from pyspark.sql import SparkSession

# Conservative defaults for a single-node run. On a cluster the operator sets
# these in spark-defaults; we never override a value that is already set.
LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of intermediates are removed once no DataFrame refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # dimension tables are tiny; the fact never goes below this threshold.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def local_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "ledgerline") -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("LEDGERLINE_DRIVER_MEMORY", "16g"))
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points to shared storage and is used as is; there
    it must be set. Only a session in local mode (tests, one machine) gets a
    scratch folder when it is unset.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="ledgerline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(current)
    return current


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder, for written intermediates."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_WITHIN: dict[str, tuple[int, str | None]] = {}  # session -> (how many are within, the caller's setting)


@contextlib.contextmanager
def shuffles_go(spark: SparkSession):
    """Within this, the shuffle files of a write are removed when it has ended.

    Otherwise they stay until the driver's garbage collector finds their plan, so the shuffles of all writes before lie on
    the disks together. A plan that runs again shuffles again. The caller's setting is put back when the last one leaves.
    """
    own = spark._jsparkSession.sessionUUID()
    with _LOCK:
        n, before = _WITHIN.get(own, (0, None))
        _WITHIN[own] = (n + 1, before if n else spark.conf.get(SHUFFLES_GO, None))
        spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WITHIN.pop(own)
            if n > 1:
                _WITHIN[own] = (n - 1, before)
            elif before is None:
                spark.conf.unset(SHUFFLES_GO)
            else:
                spark.conf.set(SHUFFLES_GO, before)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a written intermediate that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
