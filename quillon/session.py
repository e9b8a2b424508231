"""Session set-up and table access shared by every query."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SHIPPED = "quillon.shipped"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for local work: UTC, adaptive execution and few shuffle partitions."""
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; the path may be any that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for Python code that runs there."""
    sc = spark.sparkContext
    if getattr(sc, "_quillon_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="quillon-"), "quillon.zip")
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    sc.addPyFile(target)
    sc._quillon_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all machines share; in local mode a folder of our own where that is unset."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner take the broadcasts and plans of queries that have ended: it waits until both sides have let go."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Intermediate tables: written as Parquet under the shared checkpoint folder, deleted as soon as no step needs them.

    As a context it also lets Spark delete the shuffle files of each query that runs inside once that query has ended.
    What is kept at the end (the result may read it) goes when the application ends.
    """

    _CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark)}/quillon-{uuid.uuid4().hex}"
        self.number = 0

    def __enter__(self) -> Scratch:
        self.before = self.spark.conf.get(self._CLEANUP, "false")
        self.spark.conf.set(self._CLEANUP, "true")
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.spark.conf.set(self._CLEANUP, self.before)
        tidy(self.spark)
        if kind is not None:
            delete_folder(self.spark, self.folder)
        else:
            atexit.register(self._at_exit)

    def _at_exit(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # the application may be gone already
                delete_folder(self.spark, self.folder)

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows, read from a written table: its lineage starts there."""
        self.number += 1
        path = f"{self.folder}/{self.number}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._quillon_path = path
        return kept

    def keep_counted(self, df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
        """keep(), and the number of rows for which the condition holds, counted while they are written."""
        seen = Observation()
        kept = self.keep(df.observe(seen, F.count(F.when(condition, 1)).alias("n")))
        return kept, seen.get["n"]

    def drop(self, *tables: DataFrame) -> None:
        for kept in tables:
            delete_folder(self.spark, kept._quillon_path)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared checkpoint folder and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
