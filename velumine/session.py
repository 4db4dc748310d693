"""Sessions and the places where intermediate tables are kept."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the operators are tested under; on a cluster use its own session."""
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: their Python need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_velumine_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="velumine-code-")  # read whenever an executor starts, so it stays to the end
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    source = Path(folder, "velumine")
    shutil.copytree(Path(__file__).parent, source, ignore=shutil.ignore_patterns("__pycache__"))
    archive = Path(folder, "velumine-code.zip")
    with zipfile.PyZipFile(str(archive), "w") as z:
        z.writepy(str(source))
    context.addPyFile(str(archive))
    context._velumine_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; a temporary one only where the setting is absent and all runs on this
    machine (tests). On a cluster, tables in a folder of one machine would be lost to the others, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="velumine-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """Intermediate Parquet tables of one query, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship(spark)
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/velumine-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` to the shared folder and return a scan of what was written."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Remove a table made by ``keep`` that no later plan reads."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def purge(spark: SparkSession, hours: float = 24.0) -> int:
    """Remove intermediate tables that were made more than ``hours`` ago; returns how many. Results that are read lazily
    need their tables, so nothing is removed by itself."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(checkpoint_root(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before, n = (time.time() - hours * 3600) * 1000, 0
    for status in fs.listStatus(root) if fs.exists(root) else []:
        if status.getPath().getName().startswith("velumine-") and status.getModificationTime() < before:
            n += bool(fs.delete(status.getPath(), True))
    return n


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core. A no-op for inputs of many files, where a shuffle would be waste."""
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
