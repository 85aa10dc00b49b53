"""Cutting lineage through tables on reliable storage."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a scratch folder only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table under the checkpoint folder and continue from it.

    The copy survives lost executors, keeps column pruning and filter pushdown, and ends the
    plan: later stages neither recompute nor re-analyse what led here.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_all(*frames: DataFrame) -> list[DataFrame]:
    """Write independent stage tables at the same time, so that one's tail fills with the other's tasks."""
    ensure_checkpoint_dir(frames[0].sparkSession)
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(inheritable(frames[0].sparkSession, cut), frames))


def inheritable(spark: SparkSession, fn):
    """Carry the caller's job group and session into the worker threads."""
    return inheritable_thread_target(spark)(fn)


def table_exists(spark: SparkSession, path: str) -> bool:
    """A completed table (its success marker) is still at ``path``."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the session's shuffle width.

    For compute-heavy stages on compact tables: adaptive coalescing goes by bytes and would
    pack such a table into one or two tasks.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *keys)
