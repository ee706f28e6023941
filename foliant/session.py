"""Session factory and small helpers shared by all operators."""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "foliant", master: str | None = None, shuffle_partitions: int | None = None, driver_memory: str | None = None) -> SparkSession:
    """A session with UTC, AQE and Arrow on. Master and shuffle width are left to spark-submit when not given."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once, unless their PYTHONPATH has it already."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_foliant_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "foliant.zip")  # read by the driver's file server only
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(os.path.join(root, "foliant")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._foliant_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; column pruning and filters reach the parquet scan."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; only on one machine, where none is set (tests), a local one is chosen."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder; a cluster's executors cannot share a machine's own")
        path = os.path.join(tempfile.gettempdir(), f"foliant-checkpoint-{uuid.uuid4().hex}")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
