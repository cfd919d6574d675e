"""Session settings and the one place where intermediate tables are written."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # source files differ much in size, so batches for Python workers are bounded by bytes as well
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.sql.files.maxPartitionBytes": "64m",
    # state of streams grows with the rows that wait, not with the heap: it is kept on disk, behind a cache of bounded size
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    # one store for a join of streams and partition instead of four
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings this package is written for."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def uncounted(spark: SparkSession) -> Iterator[None]:
    """Streams started inside do not count the rows of their state, which costs one more read of the store for each row put."""
    key = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, as named by the cluster.

    Only a local session without one gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="auditspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage like a checkpoint, survives lost executors, and unlike a checkpoint
    lets later readers load only the columns they use.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/auditspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an input of few splits over all cores before heavy work per row.

    An input that already has a split per core, as any large one has, is left as it is. Meant for a
    table that is read directly; the keys make a repeated task give the same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions for shuffles in front of Python workers.

    Naming the number keeps adaptive execution from merging partitions by size: such rows are few
    bytes and much work.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
