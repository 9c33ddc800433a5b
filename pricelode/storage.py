"""Intermediate tables of a cycle in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the cluster's ``spark.checkpoint.dir``; a folder of our own only where that is unset and there is but one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-pricelode-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/pricelode/{name}-{uuid.uuid4().hex}"


#: Where each table is that :func:`kept` wrote.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: a step's plan stays small, and a lost executor costs a reread.

    The step's shuffles go when it is written, not when the driver's memory is next cleaned: else those of all steps lie on the disks at once."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, was)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of :func:`kept` that nothing reads any more; other tables stay."""
    for table in tables:
        if path := _PLACES.pop(table, None):
            drop_folder(table.sparkSession, path)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it isn't there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return "_SUCCESS" in subfolders(spark, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
