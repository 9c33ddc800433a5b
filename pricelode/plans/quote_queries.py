"""Queries of the quote operators: numbers, taxes, cases, invoices, alerts, margins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.constants import TAX_OPTIONS
from pricelode.functions import numbers as N
from pricelode.operators import classify
from pricelode.plans.registry import query, table


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round_even(l_extendedprice * 100, 0) as bigint) as en_cents, cast(round_even(l_extendedprice * 100, 0) as bigint) as es_cents,
 cast(round_even(l_extendedprice * 100, 0) as bigint) as list_cents from lineitem""")
def q10_price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written in both locales read back to the same cents."""
    lines = table(spark, sf_dir, "lineitem")
    english = F.format_number("l_extendedprice", 2)
    spanish = F.translate(english, ",.", ".,")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.cents(N.export_number(F.concat(F.lit("$ "), english))).alias("en_cents"),
        N.cents(N.message_number(spanish)).alias("es_cents"), N.cents(N.list_number(spanish, F.lit(","))).alias("list_cents"),
    )


@query("""with t as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, case when l_suppkey % 2 = 0 then format('{:,.2f}', l_extendedprice) else format('{:t.2f}', l_extendedprice) end as txt from lineitem),
s as (select l_suppkey, case when l_suppkey % 2 = 0 then case when l_extendedprice >= 1000 then '.' else '.' end else case when l_extendedprice >= 1000 then ',' else null end end as sig, l_orderkey, l_linenumber, l_partkey, l_extendedprice from t)
select l_suppkey, coalesce(arg_min(sig, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) filter (where sig is not null), ',') as decimal_mark, count(*) as n from s group by 1""")
def q11_decimal_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first price of a supplier whose form is unmistakable tells the decimal mark."""
    lines = table(spark, sf_dir, "lineitem")
    english = F.format_number("l_extendedprice", 2)
    written = F.when(F.col("l_suppkey") % 2 == 0, english).otherwise(F.translate(english, ",.", ".,"))
    signal = N.decimal_signal(written)
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    first = F.min_by(signal, F.when(signal.isNotNull(), order))
    return lines.groupBy("l_suppkey").agg(F.coalesce(first, F.lit(",")).alias("decimal_mark"), F.count("*").alias("n"))


@query("""with o(option, rate, surcharge, included) as (values ('incluido', 0.21::double, 0.0::double, true), ('21', 0.21::double, 0.0::double, false), ('21+3', 0.21::double, 0.03::double, false)),
b(net) as (values (true), (false)), p as (select p_partkey, p_retailprice x from part)
select p_partkey, option, net, cast(round_even(100 * case when net then case when included then x / (1 + rate) else x end else case when included then x else x * (1 + rate) * (1 + surcharge) end end, 0) as bigint) as cost_cents,
 included = net as rate_needed from p cross join o cross join b""")
def q12_tax_truth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each price under each option and kind of business, as columns of one row each."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("x"))
    fixed = [o for o, (rate, _, _) in TAX_OPTIONS.items() if not isinstance(rate, str)]
    cases = F.explode(F.array(*(F.struct(F.lit(o).alias("option"), F.lit(n).alias("net")) for o in fixed for n in (True, False))))
    rows = p.select("*", cases.alias("c")).select("p_partkey", "x", "c.*")
    rate, _, extra, included = N.option_rates(F.col("option"))
    cost = N.list_cost(F.col("x"), rate, extra, included, F.col("net"))
    return rows.select("p_partkey", "option", "net", N.cents(cost).alias("cost_cents"), N.rate_needed(included, F.col("net")).alias("rate_needed"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(case when l_quantity > 1 then round_even(round_even(l_extendedprice / l_quantity * 10000, 0) / 10000 * 100, 0) else round_even(l_extendedprice * 100, 0) end as bigint) as unit_cents,
 l_quantity >= 2 and abs(l_extendedprice / p_retailprice - 1) > 0.5 and abs(l_extendedprice / l_quantity / p_retailprice - 1) < 0.35 as suggested from lineitem join part on p_partkey = l_partkey""")
def q13_per_unit_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N10, N11."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    price, units = F.col("l_extendedprice"), F.col("l_quantity")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.cents(N.per_unit(price, units)).alias("unit_cents"), N.case_suggested(price, F.col("p_retailprice"), units).alias("suggested"))


@query("""with x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount * 8) amount, l_quantity q, l_extendedprice / l_quantity u from lineitem),
r as (select *, round_even(amount / q * 100, 0) / 100 as real from x)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round_even(real * 100, 0) as bigint) as cost_cents from r where real >= u * 0.4 and real <= u * 1.05""")
def q14_invoice_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N12."""
    lines = table(spark, sf_dir, "lineitem")
    cost = N.invoice_cost(F.col("l_extendedprice") * (1 - F.col("l_discount") * 8), F.col("l_quantity"), F.col("l_extendedprice") / F.col("l_quantity"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.cents(cost).alias("cost_cents")).filter("cost_cents is not null")


STATE = "case l_linenumber % 4 when 0 then 'sin match' when 1 then 'revisar' when 2 then 'sin cambio' else 'ok' end"


@query(f"""with x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, {STATE} as state, l_quantity * 2 as score, case when l_partkey % 11 = 0 then 0.0 else p_retailprice end as current,
 case when l_partkey % 11 = 0 then null else (l_extendedprice / l_quantity / p_retailprice - 1) * 100 end as change, l_partkey % 5 = 0 as conflict, l_suppkey % 13 = 0 as missing, l_returnflag = 'R' as other,
 l_partkey % 10 = 0 as ok_size, l_partkey % 17 = 0 as ok_change, l_orderkey % 3 = 0 as ok_cycle from lineitem join part on p_partkey = l_partkey),
a as (select *, case when state = 'sin match' then 'sin match' when missing and state = 'ok' then 'falta IVA' when other and state <> 'sin cambio' then 'otra fuente' when ok_change then ''
 when conflict and not ok_size then 'presentación distinta' when abs(change) > 30 then case when ok_cycle then '' else 'variación fuerte' end when current = 0 then case when ok_cycle then '' else 'no tenía costo cargado' end
 when score < 75 then 'match dudoso' when state = 'revisar' then 'match a confirmar' else '' end as alert from x)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, alert, alert = '' and state = 'ok' and not missing as ready from a""")
def q15_alert_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert cascade, first match wins."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    new = F.col("l_partkey") % 11 == 0
    state = F.expr(STATE)
    missing = F.col("l_suppkey") % 13 == 0
    word = classify.alert(
        state, F.col("l_quantity") * 2, F.when(new, 0.0).otherwise(F.col("p_retailprice")),
        F.when(~new, (F.col("l_extendedprice") / F.col("l_quantity") / F.col("p_retailprice") - 1) * 100), F.col("l_partkey") % 5 == 0, missing, F.col("l_returnflag") == "R",
        F.col("l_partkey") % 10 == 0, F.col("l_partkey") % 17 == 0, F.col("l_orderkey") % 3 == 0,
    )
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", word.alias("alert"), classify.ready(word, state, missing).alias("ready"))


@query("""with x as (select p_partkey, p_retailprice as before, p_retailprice * (0.7 + (p_partkey % 60) / 100.0::double) as cost, p_retailprice * 1.25 as price, p_size % 2 = 0 as variable from part),
y as (select *, round_even((cost / before - 1) * 100 * 10, 0) / 10 as change from x),
z as (select *, cast(round_even(case when variable then (price - cost) / price else (price - before) / price end * 1000, 0) as bigint) as margin_tenths,
 cast(round_even(100 * case when variable then price else price * cost / before end, 0) as bigint) as estimate_cents,
 concat_ws(' · ', case when variable and cost >= price then 'el costo nuevo es mayor o igual al precio de venta' when variable and (price - cost) / price < 0.10 then 'queda menos de 10% de margen' end,
 case when abs(change) > 15 then 'cambia ' || case when change >= 0 then '+' else '' end || cast(round_even(change, 0) as bigint) || '%' end, case when change < 0 then 'baja de precio' end) as look from y)
select p_partkey, margin_tenths, estimate_cents, look from z""")
def q22_control_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14."""
    p = table(spark, sf_dir, "part")
    rows = p.select("p_partkey", F.col("p_retailprice").alias("before"), (F.col("p_retailprice") * (0.7 + (F.col("p_partkey") % 60) / 100)).alias("cost"), (F.col("p_retailprice") * 1.25).alias("price"), (F.col("p_size") % 2 == 0).alias("variable"))
    rows = classify.control(rows.withColumn("change", N.variation(F.col("cost"), F.col("before"))), F.col("variable"))
    return rows.select("p_partkey", F.rint(F.col("margin") * 10).cast("long").alias("margin_tenths"), N.cents(F.col("estimate")).alias("estimate_cents"), "look")


@query("""with d as (select l_partkey, l_orderkey, min(l_extendedprice / l_quantity) cost from lineitem group by all),
w as (select *, lag(cost) over (partition by l_partkey order by l_orderkey) old from d)
select l_partkey, l_orderkey, cast(round_even((cost / old - 1) * 1000, 0) as bigint) as change_tenths, abs(cost - old) < 0.01 as unchanged from w where old is not null""")
def q23_variation_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: each cost against the one before it."""
    costs = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("cost"))
    old = F.lag("cost").over(Window.partitionBy("l_partkey").orderBy("l_orderkey"))
    rows = costs.withColumn("old", old).filter("old is not null")
    return rows.select("l_partkey", "l_orderkey", F.rint((F.col("cost") / F.col("old") - 1) * 1000).cast("long").alias("change_tenths"), N.unchanged(F.col("cost"), F.col("old")).alias("unchanged"))
