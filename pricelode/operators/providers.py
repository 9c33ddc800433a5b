"""Supplier cards, product lookup by typed name, review cards, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelode.constants import PER_PRODUCT, TAX_SORT
from pricelode.functions.numbers import option_rates
from pricelode.functions.text import normalize
from pricelode.operators import memory
from pricelode.operators.alike import name_pairs
from pricelode.operators.ordering import first_per, top_per


def card_names(cards: DataFrame) -> DataFrame:
    """seq, nombre and each normalized name of a supplier card: its own and those in its alias list."""
    names = F.concat(F.array("nombre"), F.filter(F.transform(F.split("alias", r"\|"), lambda x: F.trim(x)), lambda x: x != ""))
    return cards.select("seq", "nombre", F.explode(names).alias("raw")).select("seq", "nombre", normalize("raw").alias("name"))


def find_cards(asked: DataFrame, cards: DataFrame) -> DataFrame:
    """(asked, nombre) for typed supplier names (asked): equal name or alias first, else alike; first card wins."""
    names = card_names(cards)
    want = asked.select("asked", normalize("asked").alias("key")).distinct()
    exact = want.join(names, want["key"] == names["name"]).select("asked", "nombre", "seq", F.lit(0).alias("way"))
    pairs = name_pairs(want.select(F.col("key").alias("name")), names.select("name"), "sort", TAX_SORT)
    near = want.join(pairs, want["key"] == pairs["l"]).join(names, F.col("r") == names["name"]).select("asked", "nombre", "seq", F.lit(1).alias("way"))
    return top_per(exact.unionByName(near), ["asked"], [F.col("way"), F.col("seq")]).select("asked", "nombre")


def find_products(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """(asked, referencia) for typed product names: the full name as it stands, else its normalized form."""
    names = catalog.select("seq", "referencia", "nombre_completo", normalize("nombre_completo").alias("name_key"))
    want = asked.select("asked", normalize("asked").alias("key")).distinct()
    exact = want.join(names, want["asked"] == names["nombre_completo"]).select("asked", "referencia", "seq", F.lit(0).alias("way"))
    same = want.join(names, want["key"] == names["name_key"]).select("asked", "referencia", "seq", F.lit(1).alias("way"))
    return top_per(exact.unionByName(same), ["asked"], [F.col("way"), F.col("seq")]).select("asked", "referencia")


def register(asked: DataFrame, cards: DataFrame) -> DataFrame:
    """M8: the cards with those of typed names (asked, tipo) that no card is like; a known card without a kind takes the new one."""
    tidy = asked.select(F.trim(F.regexp_replace("asked", r"\s+", " ")).alias("asked"), "tipo").filter("asked <> ''")
    known = find_cards(tidy, cards)
    kinds = tidy.join(known, "asked").filter("tipo <> ''").groupBy("nombre").agg(F.min("tipo").alias("_tipo"))
    old = cards.join(kinds, "nombre", "left").withColumn("tipo", F.when(F.col("tipo") == "", F.coalesce("_tipo", F.lit(""))).otherwise(F.col("tipo"))).select(cards.columns)
    new = tidy.join(known, "asked", "left_anti").groupBy(normalize("asked").alias("_key")).agg(F.min("asked").alias("nombre"), F.max("tipo").alias("tipo"))
    blank = {c: F.lit("") for c in ("alias", "iva_lista", "nota")}
    new = new.select(F.row_number().over(Window.orderBy("nombre")).cast("long").alias("seq"), "nombre", "tipo", F.lit("fijo").alias("margen"), *(v.alias(c) for c, v in blank.items()))  # names typed at once
    return memory.append(old, new.select(cards.columns))


def set_tax(asked: DataFrame, cards: DataFrame, taxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M9: cards and tax rules after typed names (asked, iva_lista) said how their prices come; other words change nothing."""
    rate, per, extra, included = option_rates(F.col("iva_lista"))
    said = asked.filter(per.isNotNull())
    cards = register(said.select("asked", F.lit("").alias("tipo")), cards)
    named = find_cards(said.select("asked"), cards).join(said, "asked").groupBy("nombre").agg(F.max("iva_lista").alias("_iva"))
    new_cards = cards.join(named, "nombre", "left").withColumn("iva_lista", F.coalesce("_iva", "iva_lista")).select(cards.columns)
    word = F.when(per, PER_PRODUCT).otherwise(rate.cast("string"))
    rules = named.withColumnRenamed("_iva", "iva_lista").select(
        F.row_number().over(Window.orderBy("nombre")).cast("long").alias("seq"), F.lit("proveedor").alias("ambito"), F.col("nombre").alias("clave"), word.alias("iva"), extra.cast("string").alias("percepcion"),
        F.lit("según la ficha del proveedor").alias("nota"), F.when(included, "si").otherwise("").alias("incluido"),
    )
    keys = rules.select(normalize("clave").alias("_key"))
    old = taxes.withColumn("_key", F.when(F.col("ambito") == "proveedor", normalize("clave"))).join(keys, "_key", "left_anti").select(taxes.columns)
    return new_cards, memory.append(old, rules.select(taxes.columns))


def supplier_list(cards: DataFrame) -> DataFrame:
    """Cards with their aliases apart, margin fijo where none is named, in order of names."""
    alias = F.filter(F.transform(F.split("alias", r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    margin = F.when(F.col("margen") == "", "fijo").otherwise(F.col("margen"))
    return cards.select("nombre", alias.alias("alias"), "tipo", "iva_lista", margin.alias("margen"), "nota").orderBy(F.lower("nombre"), "nombre")


def variable_margin(cards: DataFrame) -> DataFrame:
    """M10."""
    return cards.filter("margen = 'variable'").select("nombre")


def tax_known(cards: DataFrame) -> DataFrame:
    """M9: which suppliers have said how their prices come, and the rates of that."""
    rate, per, extra, included = option_rates(F.col("iva_lista"))
    return first_per(cards, ["nombre"]).select("nombre", per.isNotNull().alias("known"), rate.alias("rate"), per.alias("per_product"), extra.alias("surcharge"), included.alias("included"))


def review_cards(asked: DataFrame) -> DataFrame:
    """What a person sees for a row: kind of question, options with the current product first, in a fixed order."""
    kind = (
        F.when(F.col("alerta") == "sin match", "elegir").when(F.col("alerta").isin("match a confirmar", "match dudoso"), "confirmar").when(F.col("alerta") == "falta IVA", "iva")
        .when(F.col("alerta") == "otra fuente", "fuente").when(F.col("alerta") == "presentación distinta", "gramaje").when(F.col("alerta").startswith("otro renglón"), "preferir").otherwise("aprobar")
    )
    none = F.array().cast("array<struct<referencia:string,score:int>>")
    options = F.coalesce("options", none)
    own = F.struct(F.col("referencia").alias("referencia"), F.col("score").alias("score"))
    first = F.when(F.col("referencia").isNotNull() & ~F.exists(options, lambda o: o["referencia"] == F.col("referencia")), F.array_prepend(options, own)).otherwise(options)
    return asked.withColumn("tarjeta", kind).withColumn("options", first).orderBy(F.col("nombre_odoo").isNull(), F.lower("nombre_odoo"), "fuente", "clave_renglon")


def memory_counts(tables: dict[str, DataFrame]) -> dict[str, int]:
    """A9."""
    return {name: df.count() for name, df in tables.items()}
