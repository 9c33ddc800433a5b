"""Memory tables and their upserts (M1-M7, M9-M11, F6, K7, K8) as DataFrames over a snapshot folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.functions.text import code_key, normalize

#: Tables and their columns, all text; fixed names.
TABLES = {
    "alias": ("texto", "referencia", "proveedor", "nota"),
    "proveedor_alias": ("alias", "proveedor"),
    "codigos_proveedor": ("proveedor", "codigo_proveedor", "descripcion_proveedor", "referencia_odoo", "unidades"),
    "ignorar": ("texto", "proveedor", "motivo"),
    "aprobados": ("referencia", "tipo", "motivo"),
    "rotaciones": ("grupo", "referencia", "proveedor", "nota"),
    "reglas_proveedor": ("proveedor", "cotiza_por", "iva", "nota"),
    "impuestos": ("ambito", "clave", "iva", "percepcion", "nota", "incluido"),
    "historial": ("fecha", "referencia", "producto", "costo_anterior", "costo_nuevo", "fuente", "origen", "linea", "estado"),
    "procesados": ("fuente", "huella", "fecha", "origen"),
    "proveedores": ("nombre", "alias", "tipo", "iva_lista", "margen", "nota"),
    "abreviaturas": ("texto", "significa", "nota"),
    "no_son_productos": ("empieza_con", "nota"),
    "ajustes": ("clave", "valor"),
}


def schema_of(name: str) -> str:
    return "seq long, " + ", ".join(f"{c} string" for c in TABLES[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(name))


def aligned(df: DataFrame, name: str) -> DataFrame:
    """The table's columns; missing ones and nulls are empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in TABLES[name]]
    seq = F.col("seq") if "seq" in df.columns else F.monotonically_increasing_id()
    return df.select(seq.alias("seq"), *cells)


def _next(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Numbers new rows after the old ones."""
    top = df.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_top"))
    return rows.crossJoin(F.broadcast(top)).withColumn("seq", F.col("seq") + F.col("_top") + 1).drop("_top")


def _same(keys: list[str], left: DataFrame, right: DataFrame):
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def upsert(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """M3: a key's last decision wins; others stay as they are."""
    return df.join(rows, _same(keys, df, rows), "left_anti").unionByName(_next(df, rows))


def upsert_codes(df: DataFrame, rows: DataFrame) -> DataFrame:
    """M6: a supplier's code by its normalized name and code; units that were learned stay unless there are new ones."""
    keyed = [d.withColumns({"_name": normalize("proveedor"), "_code": code_key(F.col("codigo_proveedor"))}) for d in (df, rows)]
    known = keyed[0].groupBy("_name", "_code").agg(F.min_by("unidades", "seq").alias("_units"))
    new = keyed[1].join(known, ["_name", "_code"], "left").withColumn("unidades", F.coalesce(F.when(F.col("unidades") != "", F.col("unidades")), "_units", F.lit("")))
    return keyed[0].join(keyed[1], ["_name", "_code"], "left_anti").select(df.columns).unionByName(_next(df, new.select(df.columns)))


def insert_absent(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """M5, M7: only keys that aren't there yet."""
    return df.unionByName(_next(df, rows.dropDuplicates(keys).join(df, _same(keys, rows, df), "left_anti")))


def append(df: DataFrame, rows: DataFrame) -> DataFrame:
    """M4, K6."""
    return df.unionByName(_next(df, rows))


def decided(df: DataFrame, log: DataFrame, op: str) -> DataFrame:
    """A table with the decisions of its log (batch, op, and the table's columns) on it, as if each had been made on what the one before it left.

    ``op`` says how: ``append`` (M4, K6), ``upsert:keys`` (M3: a key's last decision wins), ``absent:keys`` (M5, M7: the first that a key has), or ``codes``
    (M6: the last decision for a supplier's normalized name and code, with the last units that were said, else those of the table)."""
    kind, _, names = op.partition(":")
    keys = names.split(",") if names else []
    new = log.drop("op")
    if kind == "codes":
        keys = ["_name", "_code"]
        df, new = (d.withColumns({"_name": normalize("proveedor"), "_code": code_key(F.col("codigo_proveedor"))}) for d in (df, new))
        units = new.filter("unidades <> ''").groupBy(*keys).agg(F.max_by("unidades", "seq").alias("_said"))
        known = df.groupBy(*keys).agg(F.min_by("unidades", "seq").alias("_known"))
        new = new.join(units, keys, "left").join(known, keys, "left").withColumn("unidades", F.coalesce("_said", "_known", F.lit(""))).drop("_said", "_known")
    if keys:
        which = F.min if kind == "absent" else F.max
        new = new.withColumn("_batch", which("batch").over(Window.partitionBy(*keys))).filter("batch = _batch").drop("_batch")
        if kind == "absent":
            new = new.dropDuplicates(keys).join(df.select(*keys).distinct(), keys, "left_anti")
        else:
            df = df.join(new.select(*keys).distinct(), keys, "left_anti")
    columns = ["seq", *(c for c in df.columns if c != "seq" and not c.startswith("_"))]
    return df.select(columns).unionByName(_next(df.select(columns), new.select(columns)))


def not_processed(df: DataFrame, processed: DataFrame, keys: list[str], forced: DataFrame | None = None) -> DataFrame:
    """rows whose fingerprint is new, or was forced."""
    seen = processed.select(*keys).distinct()
    if forced is not None:
        seen = seen.join(forced, keys[-1], "left_anti")
    return df.join(seen, keys, "left_anti")
