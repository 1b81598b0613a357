"""Tables that are written to the folder which driver and executors share, and read again.

They cut the lineage of iterations: a lost executor costs a reread, not the rounds before.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder in its place only in single-process local mode."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="blobweave-regions-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def fresh(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{folder(spark)}/regions/{what}-{uuid.uuid4().hex}"


def stage(df: DataFrame, what: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again; ``unstage`` deletes it."""
    spark = df.sparkSession
    path = fresh(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables; nothing that reads them can be read afterwards."""
    for df in tables:
        if at := getattr(df, "_staged_at", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
