"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_base: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path under ``spark.checkpoint.dir``.

    The setting is read from the session.  Where it is unset a temporary folder
    takes its place under a local master (tests); on a cluster that is an error,
    as executors would write to different disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_base:
            _own_base.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        base = _own_base[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def never_broadcast(df: DataFrame) -> DataFrame:
    """``df`` for a join of two tables that grow with the input.

    Files of ``written`` hold names many times smaller than rows in memory do, and
    Spark takes the files' size for the table's: the driver would be sent millions of rows.
    """
    return df.hint("merge")


def spent(*tables: DataFrame) -> None:
    """Delete the files of tables from ``written`` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_shared_path", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
            df._shared_path = None
