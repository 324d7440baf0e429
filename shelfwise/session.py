"""Session construction and shared-storage helpers.

Scratch output (CSV round trips, saved pipelines, stream sinks, checkpoints) goes
under the folder named by ``spark.checkpoint.dir``. On a cluster that setting names a
shared file system; it is read from the session and only filled in when unset
(local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


_PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of any cluster: once per
    application the sources are zipped and added as a Python file (as ``--py-files`` would)."""
    sc = spark.sparkContext
    if getattr(sc, "_shelfwise_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="shelfwise-src-"), f"shelfwise-{uuid.uuid4().hex[:8]}.zip")
    root = os.path.dirname(_PACKAGE_DIR)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(_PACKAGE_DIR):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)  # served by the driver, fetched by every executor
    sc._shelfwise_shipped = True


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "shelfwise") -> SparkSession:
    """Local/session builder with the settings every job here assumes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    elif master and master.startswith("local["):
        builder = builder.config("spark.sql.shuffle.partitions", "8")  # a cluster's own setting stands
    if master and master.startswith("local"):
        # local mode runs every task in the driver JVM: give it half of a 16 GiB box
        builder = builder.config("spark.driver.memory", os.environ.get("SHELFWISE_DRIVER_MEMORY", "8g"))
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a private one only when unset on a
    local master. ``local-cluster`` counts as a cluster."""
    sc = spark.sparkContext
    root = sc.getConf().get(_CHECKPOINT_KEY, None) or sc.getCheckpointDir()
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # unset only in local runs and tests, where one process has the only disk
        root = tempfile.mkdtemp(prefix="shelfwise-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the checkpoint folder for one job's output."""
    return f"{checkpoint_root(spark)}/shelfwise/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
