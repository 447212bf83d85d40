"""Cutting lineage by tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="treeflow-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back."""
    path = f"{shared_dir(df.sparkSession)}/treeflow-core/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a kept table that nothing reads any more."""
    delete(df.sparkSession, df._kept)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the file system that holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
