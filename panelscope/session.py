"""Session helpers: where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"

_held: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session, where every task runs on
    this machine, may fall back to a temporary folder.
    """
    root = spark.conf.get(_CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="panelscope-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, kept until ``release``."""
    path = f"{scratch_root(spark)}/panelscope/{name}-{uuid.uuid4().hex}"
    _held.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far by this program; call it when their readers are done."""
    paths, _held[:] = list(_held), []
    for path in paths:
        delete(spark, path)
    return len(paths)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark can reach."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and pins values that a re-run could change
    (range partition numbers).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
