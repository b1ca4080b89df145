"""Session construction and shared scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CHECKPOINT_FALLBACK = "/tmp/cohortcart-checkpoints"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "cohortcart", extra: dict | None = None) -> SparkSession:
    """A session for tests and the bench.  On a cluster, use the cluster's own session."""
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("COHORTCART_DRIVER_MEMORY", "16g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_parallelism(spark: SparkSession) -> int:
    """Cores of the cluster (``defaultParallelism``); the shuffle partitions where no context is
    exposed to Python (Spark Connect)."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - no JVM context in this client
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def is_local(spark: SparkSession) -> bool:
    """True when driver and tasks share one machine (``local`` masters, but not ``local-cluster``)."""
    master = spark.conf.get("spark.master", "") or ""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir`` (or already set on the context).

    With none set, a local master gets a folder under ``/tmp``; on any other master this raises,
    because executors would each write to a disk of their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server's configuration applies
        if configured:
            return configured
        raise RuntimeError("set spark.checkpoint.dir on the server to a folder all executors share") from None
    current = sc.getCheckpointDir()
    if configured:
        if not current:
            sc.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(_LOCAL_CHECKPOINT_FALLBACK)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/cohortcart-{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per context, so that functions of its modules can
    run in tasks of a session that was not started with ``--py-files``.  Call it before making a
    DataFrame that uses them: a function keeps the list of files it was made with."""
    sc = spark.sparkContext
    if getattr(sc, "_cohortcart_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="cohortcart-")) / "cohortcart.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._cohortcart_shipped = True


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parquet under the shared checkpoint directory and read back.

    Cuts the lineage: a lost executor re-reads the files instead of recomputing ``df``."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
