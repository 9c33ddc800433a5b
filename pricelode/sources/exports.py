"""The shop's product export as a raw catalog (S1): CSV by Spark, workbooks by file; all cells text, rows numbered in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.sources.office import xlsx_rows


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV export: its columns as text, and seq, which grows along the file (so that continuation rows follow theirs)."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.na.fill("").withColumn("seq", F.monotonically_increasing_id())


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """A workbook export: the first sheet, its first row the header. One upload is one bounded file."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    header, *rows = xlsx_rows(bytes(content))
    cells = [(i, *(r + [""] * (len(header) - len(r)))[: len(header)]) for i, r in enumerate(rows)]
    return spark.createDataFrame(cells, "seq long, " + ", ".join(f"`{h}` string" for h in header))
