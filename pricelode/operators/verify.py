"""After the import: was every cost taken, and did anything else change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.constants import CENT

ID_FORM = r"^[A-Za-z_][\w]*\.[\w.\-]+$"


def verify(expected: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Expected (id, cost) against both exports (id, cost), each with one row per id."""
    b, a = before.select("id", F.col("cost").alias("was")), after.select("id", F.col("cost").alias("now"))
    out = expected.join(b, "id", "left").join(a, "id", "left")
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) <= CENT
    state = F.when(F.col("now").isNull(), "no aparece").when(near("now", "cost"), "ok").when(near("now", "was"), "no se actualizó").otherwise("quedó distinto")
    return out.withColumn("state", state)


def new_products(before: DataFrame, after: DataFrame) -> DataFrame:
    """J19."""
    return after.join(before.select("id"), "id", "left_anti")


def repeated_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """New products whose name stands more than once in the new export."""
    twice = after.groupBy(F.col("name").alias("_name")).agg(F.count("*").alias("_n")).filter("_n > 1")  # counted on the map side: a frequent name is a row per task
    return after.join(before.select("id"), "id", "left_anti").join(twice, F.col("name").eqNullSafe(F.col("_name")), "left_semi")


def other_changes(expected: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Costs that changed though the file didn't hold them."""
    both = before.select("id", F.col("cost").alias("was")).join(after.select("id", F.col("cost").alias("now")), "id")
    return both.filter(F.abs(F.col("was") - F.col("now")) > CENT).join(expected.select("id"), "id", "left_anti")


def totals(checked: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """A10: one row: how many costs were taken, of how many; products before and after; new ones; and whether all is well."""
    own = checked.agg(F.count_if(F.col("state") == "ok").alias("ok"), F.count("*").alias("total"))
    fresh = new_products(before, after).agg(F.count("*").alias("new"))
    sizes = before.agg(F.count("*").alias("before")).crossJoin(after.agg(F.count("*").alias("after")))
    out = own.crossJoin(sizes).crossJoin(fresh)  # one row each
    return out.withColumn("all_well", (F.col("total") > 0) & (F.col("ok") == F.col("total")) & (F.col("new") == 0))


def checked_history(history: DataFrame, found: DataFrame, key: str = "referencia") -> DataFrame:
    """Generated rows of the history take the state that the check found (key, found); others stay as they are."""
    out = history.join(found.select(key, "found"), key, "left")
    state = F.when(F.col("estado") == "generado", F.coalesce("found", "estado")).otherwise(F.col("estado"))
    return out.withColumn("estado", state).select(history.columns)


def gate(table: DataFrame) -> DataFrame:
    """K2: violations of an import table (id, standard_price), as counts; all zero lets it pass."""
    repeated = table.groupBy("id").agg(F.count("*").alias("n"))
    ids = repeated.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("long").alias("repeated_ids"))
    rest = table.agg(
        F.count_if(~F.coalesce(F.col("id").rlike(ID_FORM), F.lit(False))).alias("bad_ids"),
        F.count_if(F.coalesce(F.col("standard_price"), F.lit(0.0)) <= 0).alias("bad_costs"),
        F.count("*").alias("total_rows"),
    )
    return ids.crossJoin(rest)


class ImportRefused(ValueError):
    """The import table would do harm."""


def refuse_bad(table: DataFrame) -> None:
    found = gate(table).first().asDict()
    if any(found[k] for k in ("repeated_ids", "bad_ids", "bad_costs")):
        raise ImportRefused(str(found))
