"""First, last, top and winner rows (D1-D5, W2, W3, J1, J7, J13). Every order is total or made so by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key. Spark keeps k rows per key and task before the shuffle."""
    n = "_n"
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(n) <= k).drop(n)


def first_per(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """First row wins."""
    return top_per(df, keys, [F.col(seq).asc()])


def last_per(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Last row wins."""
    return top_per(df, keys, [F.col(seq).desc()])


def latest_value(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The last value of each key; aggregated on the map side, so a hot key costs a row per task."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def winners(df: DataFrame, ref: str, order: list[Column], loser_columns: list[str]) -> DataFrame:
    """Rows ranked within a product; each carries its winner's columns as win_*."""
    w = Window.partitionBy(ref).orderBy(*order)
    out = df.withColumn("place", F.row_number().over(w).cast("long"))
    for c in loser_columns:
        out = out.withColumn(f"win_{c}", F.first_value(c).over(w))
    return out
