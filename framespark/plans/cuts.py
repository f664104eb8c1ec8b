"""Durable cuts of lineage: a table written to the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="framespark-")
    return _OWN[app]


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes through the cluster's own file system; a folder that is gone, or a session that is, is no error."""
    with suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_SEEN: set[str] = set()


def _root(spark: SparkSession) -> str:
    """The application's folder of cuts, deleted when the application's program ends."""
    root = f"{shared_dir(spark)}/framespark/{spark.sparkContext.applicationId}"
    if root not in _SEEN:
        _SEEN.add(root)
        atexit.register(_remove, spark, root)
    return root


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back.

    What follows starts from files, so a lost executor costs a re-read rather than a
    re-computation, and several readers share one computation. The files live as long as the program, or until ``discard``.
    """
    spark = df.sparkSession
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``cut`` that nothing will read any more; iterations call it for the round before."""
    path = getattr(df, "_cut", None)
    if path:
        _remove(df.sparkSession, path)
