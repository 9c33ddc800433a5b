"""The catalog from a raw export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.constants import ID_HEADERS, NON_PRODUCT, TRUE_WORDS
from pricelode.functions.numbers import export_number
from pricelode.functions.text import bare, folded, normalize
from pricelode.operators.ordering import first_per
from pricelode.storage import kept

DASH = " - "


def product_part(name: Column) -> Column:
    """What stands before the last dash."""
    parts = F.split(name, DASH)
    return F.trim(F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), DASH)).otherwise(name))


def supplier_part(name: Column) -> Column:
    """What stands after the last dash; empty without one."""
    return F.when(name.contains(DASH), F.trim(F.substring_index(name, DASH, -1))).otherwise("")


def brands(name: Column, key=None) -> Column:
    """Segments after the first, distinct by key, in order, joined by " | "."""
    key = key or (lambda x: F.lower(x))
    parts = F.transform(F.split(name, DASH), lambda x: F.trim(x))
    rest = F.when(F.size(parts) > 1, F.slice(parts, 2, F.size(parts))).otherwise(F.array().cast("array<string>"))

    def step(seen: Column, x: Column) -> Column:
        return F.when((key(x) == "") | F.exists(seen, lambda y: key(y) == key(x)), seen).otherwise(F.concat(seen, F.array(x)))

    return F.array_join(F.aggregate(rest, F.array().cast("array<string>"), step), " | ")


def reference(code: Column, external_id: Column) -> Column:
    """The internal code, or the external id where it is empty."""
    return F.when(F.coalesce(F.trim(code), F.lit("")) != "", F.trim(code)).otherwise(external_id)


def truth(c: Column) -> Column:
    """P4."""
    return F.lower(F.trim(c)).isin(*TRUE_WORDS)


def number_or_zero(c: Column) -> Column:
    """P5, N1."""
    return F.coalesce(export_number(c), F.lit(0.0))


def is_non_product(name: Column) -> Column:
    """coupons, shipping, discounts."""
    return name.rlike(f"(?iu){NON_PRODUCT}")


def without_prefixes(df: DataFrame, name: str, prefixes: DataFrame, column: str) -> DataFrame:
    """rows whose name, accents and case aside, starts with none of the prefixes.

    Each distinct name meets the prefixes by its own beginnings of their lengths, so any number of prefixes is an equi-join."""
    own = prefixes.select(folded(F.trim(column)).alias("_prefix")).filter("_prefix != ''").distinct()
    lengths = own.agg(F.collect_set(F.length("_prefix")).alias("_lengths"))  # one row; as many as a name is long at most
    begins = df.select(F.col(name).alias("_name")).distinct().crossJoin(F.broadcast(lengths)).select("_name", F.explode("_lengths").alias("_n"))
    hit = begins.withColumn("_prefix", F.substring(folded(F.col("_name")), F.lit(1), F.col("_n"))).join(own, "_prefix", "left_semi").select("_name").distinct()
    return df.join(hit, F.col(name) == F.col("_name"), "left_anti")


def collapse_tags(df: DataFrame, named: Column, tag: str, by: list[str], seq: str, joiner: str = "; ") -> DataFrame:
    """Rows without a name continue the named row before them; tags become one sorted text."""
    w = Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = df.withColumn("grp", F.sum(named.cast("long")).over(w))
    return grouped.groupBy(*by, "grp").agg(F.array_join(F.array_sort(F.collect_set(tag)), joiner).alias("tags"))


def summary(df: DataFrame, supplier: str, code: str, external_id: str) -> DataFrame:
    """A2."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return df.agg(
        F.count("*").alias("products"), F.countDistinct(F.when(~empty(supplier), F.col(supplier))).alias("suppliers"),
        F.count_if(empty(code)).alias("without_code"), F.count_if(empty(external_id)).alias("without_id"),
    )


#: Field -> exact technical headers, then fragments.
HEADERS = {
    "name": (("name",), ("nombre", "producto")),
    "cost": (("standard_price",), ("coste", "costo")),
    "code": (("default_code",), ("referencia interna", "referencia")),
    "list_price": (("list_price",), ("precio de venta", "precio")),
    "site": (("website_id",), ("sitio",)),
    "category": (("categ_id",), ("categoria",)),
    "tags": (("product_tag_ids",), ("etiqueta",)),
    "stock": (("qty_available",), ("cantidad a mano", "a mano")),
    "published": (("is_published",), ("publicado",)),
}


class ExportError(ValueError):
    """The export can't be used; the message is for the person who made it."""


def resolve_headers(columns: list[str]) -> dict[str, str | None]:
    """Field -> column. Exact names go before fragments; the id is never found by a fragment."""
    plain = {c: bare(c).strip() for c in columns}
    found: dict[str, str | None] = {"id": next((c for c, p in plain.items() if p in ID_HEADERS), None)}
    for field, (exact, parts) in HEADERS.items():
        by_name = next((c for n in exact for c, p in plain.items() if p == n), None)
        found[field] = by_name or next((c for n in parts for c, p in plain.items() if n in p and c != found["id"]), None)
    if not found["id"]:
        raise ExportError("the export has no external id column")
    if not found["name"]:
        raise ExportError("the export has no name column")
    return found


def continued(raw: DataFrame, named: Column, seq: str, group: str) -> DataFrame:
    """``raw`` with the ``seq`` of the last named row up to each row; null before the first. ``seq`` must be unique.

    Rows are dealt to ranges of ``seq``, and a window runs within each. What a range's first rows continue is the last named row of the ranges
    before it: one number for each range comes to the driver, and no task sees the whole export."""
    n = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(raw.repartitionByRange(n, seq).withColumn("_range", F.spark_partition_id()), "export_rows")
    last = {r["_range"]: r["last"] for r in dealt.filter(named).groupBy("_range").agg(F.max(seq).alias("last")).collect()}
    before, upto = [], None
    for i in range(max(last, default=0) + 2):
        before.append(upto)
        upto = last.get(i, upto)
    carried = F.get(F.array(*(F.lit(x).cast(raw.schema[seq].dataType) for x in before)), F.least("_range", F.lit(len(before) - 1)))
    w = Window.partitionBy("_range").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn(group, F.coalesce(F.last(F.when(named, F.col(seq)), True).over(w), carried)).drop("_range")


def build_catalog(raw: DataFrame, drop_repeated: bool = True, non_products: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """The fixed catalog columns of a raw all-string export with a ``seq`` column."""
    at = resolve_headers([c for c in raw.columns if c != seq])

    def text(field: str) -> Column:
        return F.trim(F.coalesce(F.col(f"`{at[field]}`"), F.lit(""))) if at[field] else F.lit("")

    def number(field: str) -> Column:
        return number_or_zero(F.col(f"`{at[field]}`")) if at[field] else F.lit(0.0)

    named = continued(raw, text("name") != "", seq, "_grp")
    tags = named.groupBy("_grp").agg(F.array_join(F.array_sort(F.collect_set(F.when(text("tags") != "", text("tags")))), "; ").alias("etiquetas"))
    rows = named.filter(text("name") != "").join(tags, "_grp").filter(~is_non_product(text("name")))
    name = text("name")
    out = rows.select(
        seq, F.trim(F.col(f"`{at['id']}`")).alias("id_externo"), reference(text("code"), F.trim(F.col(f"`{at['id']}`"))).alias("referencia"), text("code").alias("default_code"),
        name.alias("nombre_completo"), product_part(name).alias("producto"), supplier_part(name).alias("proveedor"), number("cost").alias("costo_actual"),
        number("list_price").alias("precio_venta"), text("site").alias("sitio_web"), text("category").alias("categoria"), "etiquetas", number("stock").alias("stock"),
        (truth(F.col(f"`{at['published']}`")) if at["published"] else F.lit(True)).alias("publicado"), brands(name).alias("marcas"),
    )
    if non_products is not None:
        out = without_prefixes(out, "nombre_completo", non_products, "empieza_con")
    if drop_repeated:
        out = first_per(out, ["nombre_completo", "default_code"], seq)
    return out.withColumn("clave", normalize("producto")).withColumn("clave_prov", normalize("proveedor"))
