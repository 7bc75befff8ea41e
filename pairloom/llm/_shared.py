"""Shared folders, materialised tables and small helpers of the corpus operators.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``: every executor reaches it, and files written there
survive lost executors.  Only with a local master and without that setting
(tests, a laptop) a folder of our own is made; a cluster without it is an error.
"""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import shared_root, ship

#: Arrow batches end at this many bytes, so that very long texts stay few per batch.
ARROW_BATCH_BYTES = 4 * 1024 * 1024


#: Blocks of texts have so many bytes at least; more where there are more ranges, so that what a block
#: sends to each range stays worth a row, up to the most that a worker's memory should meet.
BLOCK_BYTES, RANGE_BYTES, MOST_BLOCK_BYTES = 8 * 1024 * 1024, 4096, 32 * 1024 * 1024


def block_size(ranges: int) -> int:
    """Bytes of text in a block that sends a row to each of ``ranges``: rows grow with the texts, not with their square, up to 8192 ranges."""
    return min(MOST_BLOCK_BYTES, max(BLOCK_BYTES, RANGE_BYTES * ranges))


_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a worker process between tasks; other operators' caches are emptied.

    A worker outlives the stage it was started for, and the tables of one
    operator would otherwise take memory from the next.
    """
    others = [held for name, held in _caches.items() if name != owner and held]
    for held in others:
        held.clear()
    if others:
        give_back()
    return _caches.setdefault(owner, {})


def give_back() -> None:
    """Returns what this process has freed to the system; allocators would keep it for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; others have none
    if trim is not None:
        trim(0)


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes as well as by rows; let workers import this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    return spark


def new_folder(spark: SparkSession, name: str) -> str:
    """A URI under the shared root that nothing else uses."""
    return f"{shared_root(spark)}/pairloom-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.pairloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "pairloom_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files of steps whose results are written, now rather than at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filesystem(uri: str):
    """(pyarrow file system, path on it) of a shared URI; usable on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns most operators need; a null text counts as empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
