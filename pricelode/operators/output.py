"""What a cycle writes (K1-K10, A4, P14, P16, O1, O6, W12): import table behind its gate, rotation, report, control, memory snapshots."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.constants import SUPPLIER_SET
from pricelode.functions.text import normalize
from pricelode.operators import classify, memory, verify
from pricelode.operators.alike import name_pairs

#: Complete memory snapshots that stay.
#: A claim on a version that hasn't become a snapshot after so long is void.
CLAIM_SECONDS = 3600
KEPT_VERSIONS = 10

#: Sheets of the report: name -> frame of the cycle's result.
REPORT = {
    "Listos": "listos", "Confirmar": "confirmar", "Esperan IVA": "esperan_iva", "Gramajes": "gramajes", "Ignorados": "ignorados", "Fuera de catalogo": "fuera_de_catalogo",
    "Salteados": "saltados", "Sin cambio": "sin_cambio", "Avisos": "avisos", "Notas": "notas", "Control": "control", "Rotacion": "rotacion", "No mencionados": "no_mencionados",
}


def pesos(c: Column) -> Column:
    """$ 1.234,50; whole amounts without decimals; nothing for null."""
    text = F.translate(F.format_number(c, 2), ",.", ".,")
    return F.coalesce(F.concat(F.lit("$ "), F.regexp_replace(text, ",00$", "")), F.lit(""))


def percent(c: Column) -> Column:
    """+10%; nothing for null."""
    n = F.rint(c).cast("long")
    return F.coalesce(F.concat(F.when(n >= 0, "+").otherwise(""), n.cast("string"), F.lit("%")), F.lit(""))


def write_import(table: DataFrame, path: str) -> bool:
    """K2, K3: nothing is written when nothing is ready; a table that would do harm raises."""
    if table.isEmpty():
        return False
    verify.refuse_bad(table.select("id", "standard_price"))
    table.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_rotation(rotation: DataFrame, path: str) -> bool:
    """K4: what changes; publishing as TRUE or FALSE."""
    out = rotation.filter("action <> 'sin cambio'").select(F.col("id_externo").alias("id"), F.col("nombre_completo").alias("name"), F.when(F.col("action") == "PUBLICAR", "TRUE").otherwise("FALSE").alias("is_published"))
    if out.isEmpty():
        return False
    out.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_report(result: dict[str, DataFrame], path: str) -> None:
    """K5: a folder of tables, nested columns as JSON."""
    for sheet, name in REPORT.items():
        df = result[name]
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/{sheet}")


def control(result: dict[str, DataFrame], variable: DataFrame) -> DataFrame:
    """All that is about to change, what is odd first; variable (nombre): suppliers whose prices don't follow their costs."""
    ready = result["listos"].select("referencia", "default_code", F.col("nombre_odoo").alias("producto"), F.coalesce("costo_actual", F.lit(0.0)).alias("before"), F.col("costo_nuevo").alias("cost"), F.col("pv_actual").alias("price"), F.col("variacion").alias("change"), "fuente", "proveedor", "origen", "codigo", F.col("line").alias("dice"))
    names = result["gramajes"].filter("ok_rename and nombre_corregido <> ''").groupBy("referencia").agg(F.max("nombre_corregido").alias("renamed"))
    asked = ready.select(normalize("fuente").alias("name")).unionByName(ready.select(normalize("proveedor").alias("name")))
    free = name_pairs(asked, variable.select(normalize("nombre").alias("name")), "set", SUPPLIER_SET).select(F.col("l").alias("name")).distinct()
    keyed = ready.withColumns({"_f": normalize("fuente"), "_p": normalize("proveedor")})
    for k in ("_f", "_p"):
        keyed = keyed.join(free.select(F.col("name").alias(k), F.lit(True).alias(f"{k}_free")), k, "left")
    keyed = keyed.withColumn("variable", F.coalesce("_f_free", "_p_free", F.lit(False))).join(names, "referencia", "left")
    out = classify.control(keyed, F.col("variable"), F.col("renamed")).withColumn("kind", F.when(F.col("variable"), "variable").otherwise("fijo"))
    return control_order(out.select("referencia", "default_code", "producto", "before", "cost", "change", "price", "estimate", "margin", "kind", "fuente", "origen", "codigo", "dice", "look"))


class ConflictError(RuntimeError):
    """Another writer has that version; read the newest one and try again."""


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _claim(spark: SparkSession, path: str, version: int) -> None:
    """Makes the version this writer's: the file system creates the claim for one writer alone.

    A claim that never became a snapshot is void after ``CLAIM_SECONDS``: its writer is gone."""
    hadoop, files = _files(spark, path)
    claim = hadoop(f"{path}/claims/{version}")
    if files.exists(claim) and version not in complete_versions(spark, path):
        age = time.time() - files.getFileStatus(claim).getModificationTime() / 1000
        if age > CLAIM_SECONDS:
            files.delete(claim, False)
    if not files.createNewFile(claim):
        raise ConflictError(f"version {version} is another writer's")


def save_memory(tables: dict[str, DataFrame], path: str, version: int, keep: int = KEPT_VERSIONS) -> None:
    """A new snapshot beside the old ones. One writer can have a version: for all others it is a :class:`ConflictError`, and nothing
    is overwritten. Its row in the manifest is written last, so a snapshot that broke off is never read; all but the newest ``keep`` complete
    ones are deleted after that."""
    spark = next(iter(tables.values())).sparkSession
    hadoop, files = _files(spark, path)
    _claim(spark, path, version)
    try:
        for name in memory.TABLES:
            if name in tables:
                memory.aligned(tables[name], name).write.mode("overwrite").parquet(f"{path}/version={version}/{name}")
        spark.range(1).select(F.lit(version).cast("long").alias("version"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{path}/manifest")
    except Exception:
        files.delete(hadoop(f"{path}/claims/{version}"), False)
        raise
    for v in complete_versions(spark, path)[keep:]:
        files.delete(hadoop(f"{path}/version={v}"), True)


def update_memory(spark: SparkSession, path: str, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], keep: int = KEPT_VERSIONS, tries: int = 20) -> int:
    """K7, K9, S14 for several writers: the version that ``change`` of the newest snapshot's tables became.

    Where another writer was faster, the change is made again on what that one wrote, so neither's rows are lost."""
    for n in range(tries):
        newest = max(complete_versions(spark, path), default=0)
        tables = {k: v for k, v in load_memory(spark, path, newest).items()} if newest else {k: memory.empty(spark, k) for k in memory.TABLES}
        try:
            save_memory(change(tables), path, newest + 1, keep)
        except ConflictError:
            time.sleep(min(0.1 * 2**n, 5))
            continue
        return newest + 1
    raise ConflictError(f"{tries} tries, and always another writer was faster")


def complete_versions(spark: SparkSession, path: str) -> list[int]:
    """The snapshots that were finished, the newest first; older ones than the kept are gone."""
    hadoop, files = _files(spark, path)
    if not files.exists(hadoop(f"{path}/manifest")):
        return []
    return [r[0] for r in spark.read.parquet(f"{path}/manifest").select("version").distinct().orderBy(F.col("version").desc()).limit(1000).collect()]


def load_memory(spark: SparkSession, path: str, version: int | None = None, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The newest complete snapshot, or the one asked for."""
    version = complete_versions(spark, path)[0] if version is None else version
    return {n: spark.read.schema(memory.schema_of(n)).parquet(f"{path}/version={version}/{n}") for n in names or memory.TABLES}


def last_import(history: DataFrame) -> DataFrame:
    """The rows of the last day on which something went out."""
    out = history.filter("estado in ('generado', 'verificado', 'no se aplicó')")
    return out.join(out.agg(F.max("fecha").alias("fecha")), "fecha", "left_semi")


def history_tail(history: DataFrame, rows: int = 200) -> DataFrame:
    """The newest rows of the history, newest first; the number is the feature."""
    return history.orderBy(F.col("seq").desc()).limit(rows)


def source_counters(sources: DataFrame, seen: DataFrame, lines: DataFrame, articles: DataFrame | None = None) -> DataFrame:
    """A4: for each source (origin) of a cycle: messages read and seen before, priced lines, articles of lists."""
    out = sources.groupBy(F.col("origin").alias("origen")).agg(F.count_if(F.col("kind") != "lista").alias("messages"))
    again = seen.groupBy(F.col("origin").alias("origen")).agg(F.count("*").alias("again"))
    priced = lines.groupBy("origen").agg(F.count_if(F.col("tipo") == "costo").alias("prices"), F.countDistinct("huella").alias("read"))
    out = out.join(again, "origen", "left").join(priced, "origen", "full")
    listed = articles.groupBy("origen").agg(F.count("*").alias("articles")) if articles is not None else None
    out = out.join(listed, "origen", "full") if listed is not None else out.withColumn("articles", F.lit(0).cast("long"))
    return out.select("origen", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("messages", "again", "read", "prices", "articles")))


def control_order(df: DataFrame) -> DataFrame:
    """O1: flagged rows first, then the largest changes."""
    return df.orderBy((F.col("look") != "").desc(), F.abs(F.coalesce("change", F.lit(0.0))).desc())
