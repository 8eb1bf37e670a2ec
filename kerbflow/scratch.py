"""Shared scratch tables: what must outlive an executor goes to the folder named by spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import threading
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none, a session on one machine gets a temporary one; a cluster
    is refused, since its executors would write to different disks."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        own = tempfile.mkdtemp(prefix="kerbflow-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


#: Removes the shuffle files of a query at its end; a written table is read from its files, never from them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_lock, _writing = threading.Lock(), {}


@contextmanager
def _cleanup(spark: SparkSession):
    """The setting is on while any write of the session runs, and as it was when the last one ends."""
    key = spark._jsparkSession.sessionUUID()
    with _lock:
        n, before = _writing.get(key, (0, spark.conf.get(CLEANUP, "false")))
        _writing[key] = n + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writing.pop(key)
            if n > 1:
                _writing[key] = n - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def sweep(spark: SparkSession, hours: float = 48.0) -> int:
    """Deletes the workspaces under the shared root that nothing has been added to for so many hours; returns how many. Results are
    read from their workspace whenever they are used, so only a time long past says that one is done with."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    fs, gone = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), 0
    for s in fs.listStatus(root) if fs.exists(root) else []:
        if s.isDirectory() and re.fullmatch(r"[\w-]+-[0-9a-f]{32}", s.getPath().getName()) and s.getModificationTime() < (time.time() - hours * 3600) * 1000:
            gone += fs.delete(s.getPath(), True)
    return gone


class Workspace:
    """Tables written under one folder of the shared root: cut lineage, readable by every executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df written and read back; the shuffle files of the write are gone afterwards."""
        path = f"{self.path}/{name}"
        with _cleanup(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self) -> None:
        """Lets Spark remove the shuffle files of finished steps, which it does once the driver has dropped their plans."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
