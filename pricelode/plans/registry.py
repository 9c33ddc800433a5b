"""All queries of the reconciliation engine by name, each with its SQL where SQL can say the same.

The given tables stand in for the business's: part is the catalog, lineitem the quotes, orders the
cycles and history, events the decision log, documents and conversations the messages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from pricelode.plans import catalog_queries, cycle_queries, message_queries, quote_queries  # noqa: E402, F401
