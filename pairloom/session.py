"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever they run; once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_pairloom_shipped", False):
        return spark
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(), "pairloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in sorted(os.walk(here)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("pairloom", os.path.relpath(full, here)))
    sc.addPyFile(target)
    sc._pairloom_shipped = True
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``).

    Where none is named a temporary one is made and named, but only for a
    local master: executors of a cluster would each write to their own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pairloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def checkpoints(spark: SparkSession) -> None:
    """Lets ``checkpoint()`` write to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new URI under the folder that the cluster shares."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


class Steps:
    """Tables of an iteration: each is written to the shared folder and read back, and the one before is deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, None

    def keep(self, df):
        path, before = work_folder(self.spark, self.name), self.path
        df.write.parquet(path)
        self.path = path
        if before is not None:
            old = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        return self.spark.read.schema(df.schema).parquet(path)
