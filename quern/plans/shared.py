"""Folders and tables that the driver and all executors can reach."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

REPO = str(Path(__file__).resolve().parents[2])


#: Bytes of an Arrow batch between the JVM and a Python worker, which both hold; Spark's default is 64 MB.
BATCH_BYTES = 8 << 20
#: Bytes for which ``files_for`` counts a file.
FILE_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started, and bound their batches unless the session does."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if REPO not in known:
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, *known) if x)


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a local master without the setting gets a temporary folder, as in tests; a cluster
    without it raises, since executors could not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(root)
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = getattr(spark.sparkContext, "_quern_root", None)
    if root is None:
        root = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext._quern_root = root
        spark.sparkContext.setCheckpointDir(root)
        import atexit

        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"file://{root}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_root(spark)}/quern/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def files_for(*tables: DataFrame) -> int:
    """How many files a table gets that grows like ``tables``, which ``stored`` wrote.

    One for each ``FILE_BYTES`` of them. A table of ids has few bytes in each of a shuffle's partitions where nothing merges
    these, and a file costs a process on a local file system and a request on an object store, whatever its size.
    """
    size = 0
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._quern_path)
        fs_ = path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
        size += fs_.getContentSummary(path).getLength()
    return max(1, -(-size // FILE_BYTES))


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and that no later plan reads."""
    for df in tables:
        remove(df.sparkSession, df._quern_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system of its scheme."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a URI that Spark understands, and the path in it, for Python workers."""
    for hadoop, arrow in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if path.startswith(hadoop):
            path = arrow + path.removeprefix(hadoop)
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)
