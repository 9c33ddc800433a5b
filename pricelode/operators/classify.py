"""Alerts, winners, control and rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.constants import EYE_CHECK, LOW_SCORE, STRONG_VARIATION
from pricelode.functions.numbers import money


def alert(
    state: Column, score: Column, current: Column, change: Column, conflict: Column, rate_missing: Column, other_source: Column,
    ok_size: Column, ok_change: Column, ok_cycle: Column,
) -> Column:
    """The alert of a cost row: the first that holds. Nulls count as "no"."""
    no = F.lit(False)
    lift = lambda word: F.when(F.coalesce(ok_cycle, no), "").otherwise(word)
    return (
        F.when(state == "sin match", "sin match")
        .when(F.coalesce(rate_missing, no) & (state == "ok"), "falta IVA")
        .when(F.coalesce(other_source, no) & (state != "sin cambio"), "otra fuente")
        .when(F.coalesce(ok_change, no), "")
        .when(F.coalesce(conflict, no) & ~F.coalesce(ok_size, no), "presentación distinta")
        .when(F.coalesce(F.abs(change) > STRONG_VARIATION, no), lift("variación fuerte"))
        .when(F.coalesce(current, F.lit(0.0)) == 0, lift("no tenía costo cargado"))
        .when(F.coalesce(score < LOW_SCORE, no), "match dudoso")
        .when(state == "revisar", "match a confirmar")
        .otherwise("")
    )


def ready(alert_: Column, state: Column, rate_missing: Column) -> Column:
    """F9."""
    return (alert_ == "") & (state == "ok") & ~F.coalesce(rate_missing, F.lit(False))


def control(df: DataFrame, variable: Column, renamed: Column | None = None) -> DataFrame:
    """Estimated price, margin and what to look at. Needs before, cost, price, change; renamed: a product's new name, or null."""
    before, cost, price, change = (F.col(c) for c in ("before", "cost", "price", "change"))
    has = F.coalesce(price, F.lit(0.0)) != 0
    margin = F.when(variable, F.when(has, money((price - cost) / price * 100, 1))).otherwise(F.when(has & (before != 0), money((price - before) / price * 100, 1)))
    estimate = F.when(variable, price).otherwise(F.when(has & (before != 0), money(price * cost / before)))
    flags = F.array_compact(
        F.array(
            F.when(variable & has & (cost >= price), "el costo nuevo es mayor o igual al precio de venta").when(variable & has & ((price - cost) / price < 0.10), "queda menos de 10% de margen"),
            F.when(F.abs(change) > EYE_CHECK, F.concat(F.lit("cambia "), F.when(change >= 0, "+").otherwise(""), F.rint(change).cast("long").cast("string"), F.lit("%"))),
            F.when(change < 0, "baja de precio"),
            F.when(before == 0, "no tenía costo"),
            F.lit(None).cast("string") if renamed is None else F.concat(F.lit("cambia el nombre a: "), renamed),
        )
    )
    return df.withColumn("estimate", estimate).withColumn("margin", margin).withColumn("look", F.concat_ws(" · ", flags))


def rotation(groups: DataFrame, group: str, published: Column, mentioned: Column) -> DataFrame:
    """Of groups with a mention, what to publish and what to take off."""
    hit = F.coalesce(mentioned, F.lit(False))
    seen = groups.withColumn("_any", F.bool_or(hit).over(Window.partitionBy(group))).filter("_any").drop("_any")
    return seen.withColumn("action", F.when(hit, F.when(published, "sin cambio").otherwise("PUBLICAR")).otherwise(F.when(published, "DESPUBLICAR").otherwise("sin cambio")))


def not_mentioned(catalog: DataFrame, seen: DataFrame, supplier: str, ref: str, excluded: DataFrame) -> DataFrame:
    """Products of the suppliers of this cycle that no line named and no rotation holds."""
    return catalog.join(seen.select(supplier).distinct(), supplier, "left_semi").join(seen.select(ref).distinct(), ref, "left_anti").join(excluded.select(ref).distinct(), ref, "left_anti")
