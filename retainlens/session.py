"""SparkSession helper.

On a cluster the session is created by the platform; ``get_session`` only
fills in settings that are still unset so it never overrides cluster config.
"""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import SparkSession

# Settings applied only when the session does not already define them.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Reliable checkpoints (prefix sums, audit value table) are removed once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "retainlens", master: str | None = None,
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests / bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app)
        .master(master or os.environ.get("SPARK_MASTER", f"local[{cpus}]"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    )
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    event_log = os.environ.get("RETAINLENS_EVENT_LOG")
    if event_log:  # stage / task timings without the UI: Spark's event log in a scratch folder
        os.makedirs(event_log, exist_ok=True)
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return ``spark.checkpoint.dir``; set a scratch one only where unset (tests).

    On a cluster the platform names a shared folder; we never replace it with a
    machine-local one.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 — no SparkContext (e.g. Spark Connect): server-side setting
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="retainlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Reliable checkpoint (to the shared checkpoint dir) — survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and checkpoints of tables that nothing refers to any more: it does so when the
    driver collects its garbage, by itself perhaps only after the whole job."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
