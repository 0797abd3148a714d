"""Input tables and the shared working folder of a session."""

from __future__ import annotations

import ctypes
import os
import platform
import sys
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Working folder of a local session that names none.
LOCAL_DIR = "/tmp/checkpoints/lexatlas"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark whatever store the folder is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session, as in tests, may name none; it gets a local folder. On a cluster such a folder would divide a
    table among the machines, so that ValueError is raised.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or LOCAL_DIR)
    return named or LOCAL_DIR


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lexatlas/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, lost executors don't matter."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clustered(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """Like materialize, as a table of n buckets: what groups its rows by key, or by key and more, moves none of them. df
    comes in n partitions by key."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    named = f"lexatlas_{name}_{uuid.uuid4().hex}"
    df.write.option("path", path).format("parquet").bucketBy(n, key).saveAsTable(named)
    return spark.table(named)


def map_arrow(df: DataFrame, function: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """df.mapInArrow whose workers can import this package, also where only the driver has its folder on its path.

    Workers are reused by later tasks; each task gives back the memory it has freed.
    """
    env = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns memory that Arrow and the C library hold for reuse to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and platform.libc_ver()[0] == "glibc":
        ctypes.CDLL("libc.so.6").malloc_trim(0)
