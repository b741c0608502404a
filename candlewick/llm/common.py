"""Shared folder, tables in it, and small helpers that the operators of this package use."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words everywhere in this package.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is
    unset and all run in one process (tests) a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("candlewick.scratch.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="candlewick-")
        spark.conf.set("candlewick.scratch.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/candlewick/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that are done: it does so when
    nothing holds their plans any more, neither waiting events nor uncollected garbage."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    spark._jvm.System.gc()


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, read again: its lineage ends at the files, so a
    lost executor costs only a new read. Returns the table and its path, for `drop`."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def split_words(text: Column) -> Column:
    """The words of a text as an array; null gives null."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def give_back() -> None:
    """Hands memory that a Python worker no longer uses back to the system: workers wait for
    further tasks, and what they keep counts against their executor."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
