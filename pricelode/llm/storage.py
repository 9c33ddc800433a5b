"""Where intermediate tables live: a folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    A folder of our own is taken only where that is unset and there is but one machine (``local``, as in tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spark-pricelode-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def aliased(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under column names that clash with nothing (k0, k1 ...), and those names by the names they stand for.

    By position, so that names with dots, or equal but for case, are carried through; ``toDF(*docs.columns)`` turns them back."""
    names = [f"k{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def picked(docs: DataFrame, *columns: str) -> DataFrame:
    """Only these columns of ``docs``, by their exact names: another column that is equal but for case doesn't make them ambiguous."""
    frame, name = aliased(docs)
    return frame.select(*(frame[name[c]].alias(c) for c in columns))


def with_fields(frame: DataFrame, fields: str) -> StructType:
    """``frame``'s schema with more fields: what a function over Arrow batches returns that adds columns."""
    return StructType([*(StructField(f.name, f.dataType) for f in frame.schema.fields), *StructType.fromDDL(fields).fields])


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pricelode/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread of these files, never a rerun of what made them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
