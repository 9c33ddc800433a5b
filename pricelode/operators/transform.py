"""Taxes and prices per kilo on matched lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode import constants as K
from pricelode.functions.numbers import list_cost, money, option_rates, rate_needed, suggested_rate
from pricelode.functions.text import normalize, weight_kg
from pricelode.operators.alike import name_pairs
from pricelode.operators.ordering import first_per


def tax_rules(taxes: DataFrame, suppliers: DataFrame, nicknames: DataFrame) -> DataFrame:
    """M2: rules by normalized supplier: those written, those of supplier cards, and the same for other names of each.

    key, rate (null: per product), surcharge, included, seq."""
    written = taxes.filter("ambito = 'proveedor'").select("seq", normalize("clave").alias("key"), F.col("iva").alias("word"), F.expr("coalesce(try_cast(percepcion as double), 0)").alias("surcharge"), (F.col("incluido") == "si").alias("included"))
    rate, per, _, _ = option_rates(F.col("iva_lista"))
    cards = suppliers.filter(F.col("iva_lista").startswith("incluido")).select((F.col("seq") + 2**40).alias("seq"), normalize("nombre").alias("key"), F.when(per, K.PER_PRODUCT).otherwise(rate.cast("string")).alias("word"), F.lit(0.0).alias("surcharge"), F.lit(True).alias("included"))
    known = first_per(written.unionByName(cards.filter("word is not null")), ["key"])
    groups = nicknames.select(F.array("alias", "proveedor").alias("names")).unionByName(suppliers.select(F.concat(F.array("nombre"), F.filter(F.transform(F.split("alias", r"\|"), lambda x: F.trim(x)), lambda x: x != "")).alias("names")))
    numbered = groups.withColumn("g", F.monotonically_increasing_id()).select("g", F.explode("names").alias("raw")).select("g", normalize("raw").alias("key")).filter("key <> ''")
    rule = first_per(numbered.join(known, "key").select("g", "word", "surcharge", "included", "seq"), ["g"])
    other = numbered.join(rule, "g").join(known.select("key"), "key", "left_anti").withColumn("seq", F.col("seq") + 2**41).select("seq", "key", "word", "surcharge", "included")
    every = first_per(known.unionByName(other), ["key"])
    return every.select("key", F.expr("try_cast(word as double)").alias("rate"), "surcharge", "included", "seq")


def rule_of(senders: DataFrame, rules: DataFrame) -> DataFrame:
    """The first rule of equal or very similar (token_sort) name, for distinct normalized senders (name)."""
    pairs = name_pairs(senders, rules.select(F.col("key").alias("name")), "sort", K.TAX_SORT)
    return first_per(pairs.join(rules, pairs["r"] == rules["key"]).select(F.col("l").alias("sender"), "rate", "surcharge", "included", "seq"), ["sender"]).drop("seq")


def per_kilo_names(names: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct normalized names whose first rule says that they quote by the kilo."""
    keyed = rules.select("seq", "cotiza_por", normalize("proveedor").alias("key"))
    pairs = name_pairs(names, keyed.select(F.col("key").alias("name")), "set", K.SUPPLIER_SET)
    first = first_per(pairs.join(keyed, pairs["r"] == keyed["key"]).select(F.col("l").alias("name"), "cotiza_por", "seq"), ["name"])
    return first.select("name", (F.col("cotiza_por") == "kilo").alias("by_kilo"))


def apply(df: DataFrame, taxes: DataFrame, rules: DataFrame, kilo: DataFrame, net_business: bool) -> DataFrame:
    """N9 on rows with supplier_key, sender_key, price, state, via, referencia, nombre_odoo.

    The sender's rule alone decides on taxes; a product's own rate goes before it; per-kilo prices come last
    and from the untaxed price."""
    senders = df.select(F.col("sender_key").alias("name")).distinct()
    own = rule_of(senders, rules)
    product = first_per(taxes.filter("ambito = 'referencia'").select("seq", F.col("clave").alias("referencia"), F.expr("try_cast(iva as double)").alias("p_rate"), F.expr("coalesce(try_cast(percepcion as double), 0)").alias("p_surcharge")), ["referencia"]).drop("seq")
    out = df.join(own, df["sender_key"] == own["sender"], "left").join(product, "referencia", "left")
    out = out.join(kilo.withColumnsRenamed({"name": "_k1", "by_kilo": "_by1"}), F.col("supplier_key") == F.col("_k1"), "left").join(kilo.withColumnsRenamed({"name": "_k2", "by_kilo": "_by2"}), F.col("sender_key") == F.col("_k2"), "left")
    net = F.lit(net_business)
    has = F.col("included").isNotNull()
    rate = F.coalesce("p_rate", "rate")
    extra = F.when(F.col("p_rate").isNotNull(), F.col("p_surcharge")).otherwise(F.col("surcharge"))
    unknown = ~has & (F.col("sender_key") != "")
    missing = has & rate.isNull() & rate_needed(F.col("included"), net)
    taxed = F.when(has & ~missing, list_cost(F.col("price"), F.coalesce(rate, F.lit(K.VAT)), extra, F.col("included"), net)).otherwise(F.col("price"))
    kg = weight_kg(normalize("nombre_odoo"))
    by_kilo = F.coalesce("_by1", "_by2", F.lit(False)) & ~missing
    cost = F.when(by_kilo & kg.isNotNull(), money(F.col("price") * kg)).otherwise(taxed)
    percent = F.format_string("%s%%", F.regexp_replace(F.round(F.coalesce(rate, F.lit(K.VAT)) * 100, 1).cast("string"), r"\.0$", ""))
    via = (
        F.when(by_kilo & kg.isNotNull(), F.concat("via", F.lit(" · regla de tres")))
        .when(by_kilo, F.concat("via", F.lit(" · cotiza por kilo pero el nombre no dice el peso")))
        .when(missing, F.concat("via", F.lit(" · falta saber si lleva IVA 21% o 10,5%")))
        .when(unknown, F.concat("via", F.lit(" · falta saber si cotiza con o sin IVA")))
        .when(net & F.col("included"), F.concat("via", F.lit(" · sin el IVA "), percent, F.lit(" de la lista")))
        .when(has & ~F.col("included") & ~net, F.concat("via", F.lit(" · +IVA "), percent))
        .otherwise(F.col("via"))
    )
    return (
        out.withColumn("costo_nuevo", cost).withColumn("falta_iva", missing).withColumn("falta_iva_proveedor", unknown)
        .withColumn("iva_sugerido", F.when(missing, suggested_rate(F.col("nombre_odoo")))).withColumn("precio_lista", F.when(has | unknown, F.col("price")))
        .withColumn("estimated", F.when(missing, list_cost(F.col("price"), suggested_rate(F.col("nombre_odoo")), extra, F.col("included"), net)).otherwise(cost))
        .withColumn("state", F.when(by_kilo & kg.isNull(), "revisar").otherwise(F.col("state"))).withColumn("via", via)
        .drop("sender", "rate", "surcharge", "included", "p_rate", "p_surcharge", "_k1", "_k2", "_by1", "_by2")
    )
