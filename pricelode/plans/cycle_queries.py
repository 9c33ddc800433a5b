"""Queries of the cycle: winners, sources, rotation, history, upserts, verification, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.functions import numbers as N
from pricelode.functions.text import joined_letters, normalize_quoted, with_size
from pricelode.operators import classify, memory, output, verify
from pricelode.operators.ordering import latest_value, winners
from pricelode.plans.registry import query, table

HISTORY = "select l_partkey ref, l_suppkey source, o_orderdate dt, l_orderkey k, l_linenumber ln from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus <> 'P'"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_orderdate").alias("dt"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ref"), F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"))
    return lines.join(orders, F.col("k") == F.col("o_orderkey")).drop("o_orderkey")


@query("""with r as (select l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, cast(round_even(l_extendedprice * 100, 0) as bigint) c from lineitem),
w as (select *, row_number() over (partition by l_partkey order by l_quantity desc, l_orderkey desc, l_linenumber, l_suppkey, c) place, first_value(l_suppkey) over (partition by l_partkey order by l_quantity desc, l_orderkey desc, l_linenumber, l_suppkey, c) win_l_suppkey,
 first_value(c) over (partition by l_partkey order by l_quantity desc, l_orderkey desc, l_linenumber, l_suppkey, c) win_cost from w0)
select l_partkey, l_orderkey, l_linenumber, l_suppkey, c as cost, place, win_l_suppkey, win_cost from w""".replace("w as (select *,", "w0 as (select * from r), w as (select *,"))
def q16_winner_loser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row wins a product; the others say who won."""
    rows = table(spark, sf_dir, "lineitem").withColumn("cost", N.cents(F.col("l_extendedprice")))
    order = [F.col("l_quantity").desc(), F.col("l_orderkey").desc(), F.col("l_linenumber"), F.col("l_suppkey"), F.col("cost")]
    out = winners(rows.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "cost"), "l_partkey", order, ["l_suppkey", "cost"])
    return out.drop("l_quantity")


@query(f"with h as ({HISTORY}) select ref, arg_max(source, (dt, k, ln, source)) as source from h group by 1")
def q17_source_of_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who a product was last bought from."""
    return latest_value(history(spark, sf_dir), "ref", "source", "dt", "k", "ln", "source")


@query(f"""with h as ({HISTORY}), u as (select ref, arg_max(source, (dt, k, ln, source)) as usual from h group by 1)
select l_partkey, l_suppkey, usual, count(*) as rows_from_other from lineitem join u on ref = l_partkey where usual <> l_suppkey group by all""")
def q18_other_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13, F14 on equal keys: quotes that don't come from the usual source. Counted before the join."""
    usual = latest_value(history(spark, sf_dir), "ref", "source", "dt", "k", "ln", "source").withColumnRenamed("source", "usual")
    quotes = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("rows_from_other"))
    return quotes.join(usual, F.col("l_partkey") == F.col("ref")).filter("usual <> l_suppkey").select("l_partkey", "l_suppkey", "usual", "rows_from_other")


@query("""with s as (select distinct l_partkey, l_suppkey from lineitem where l_returnflag = 'R' and l_quantity > 30), c as (select distinct l_partkey, l_suppkey from lineitem), x as (select l_partkey from lineitem where l_discount >= 0.1)
select l_suppkey, l_partkey from c where exists (select 1 from s where s.l_suppkey = c.l_suppkey) and not exists (select 1 from s where s.l_partkey = c.l_partkey) and not exists (select 1 from x where x.l_partkey = c.l_partkey)""")
def q19_not_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15."""
    lines = table(spark, sf_dir, "lineitem")
    catalog = lines.select("l_partkey", "l_suppkey").distinct()
    return classify.not_mentioned(catalog, lines.filter("l_returnflag = 'R' and l_quantity > 30").select("l_partkey", "l_suppkey"), "l_suppkey", "l_partkey", lines.filter("l_discount >= 0.1")).select("l_suppkey", "l_partkey")


@query("""with m as (select distinct l_partkey from lineitem where l_quantity >= 50 and l_discount >= 0.09), g as (select p_partkey, p_brand || p_size as grp, p_partkey % 2 = 0 as published, m.l_partkey is not null as mentioned from part left join m on m.l_partkey = p_partkey),
a as (select *, bool_or(mentioned) over (partition by grp) hit from g)
select p_partkey, grp, case when mentioned then case when published then 'sin cambio' else 'PUBLICAR' end else case when published then 'DESPUBLICAR' else 'sin cambio' end end as action from a where hit""")
def q20_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17, A6."""
    m = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 and l_discount >= 0.09").select("l_partkey").distinct().withColumn("mentioned", F.lit(True))
    groups = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", "p_size").alias("grp"), (F.col("p_partkey") % 2 == 0).alias("published")).join(m, F.col("p_partkey") == F.col("l_partkey"), "left")
    return classify.rotation(groups, "grp", F.col("published"), F.col("mentioned")).select("p_partkey", "grp", "action")


EXPORTS = """b as (select o_orderkey id, o_custkey::varchar name, o_totalprice cost from orders where o_orderkey % 19 <> 0), a as (select o_orderkey id, o_custkey::varchar name, case when o_orderkey % 5 = 0 then o_totalprice * 1.1 when o_orderkey % 7 = 0 then o_totalprice + 1 else o_totalprice end cost from orders where o_orderkey % 23 <> 0),
e as (select o_orderkey id, o_totalprice * 1.1 cost from orders where o_orderkey % 10 < 6)"""


def exports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("name"), F.col("o_totalprice").alias("cost"))
    before = o.filter("id % 19 <> 0")
    after = o.filter("id % 23 <> 0").withColumn("cost", F.when(F.col("id") % 5 == 0, F.col("cost") * 1.1).when(F.col("id") % 7 == 0, F.col("cost") + 1).otherwise(F.col("cost")))
    return o.filter("id % 10 < 6").select("id", (F.col("cost") * 1.1).alias("cost")), before, after


@query(f"""with {EXPORTS} select e.id, case when a.cost is null then 'no aparece' when abs(a.cost - e.cost) <= 0.01 then 'ok' when abs(a.cost - b.cost) <= 0.01 then 'no se actualizó' else 'quedó distinto' end as state
from e left join b on b.id = e.id left join a on a.id = e.id""")
def q21_verify_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18."""
    return verify.verify(*exports(spark, sf_dir)).select("id", "state")


@query(f"""with {EXPORTS} select 'new' as kind, a.id from a where not exists (select 1 from b where b.id = a.id)
union all select 'repeated', a.id from (select *, count(*) over (partition by name) n from a) a where n > 1 and not exists (select 1 from b where b.id = a.id)
union all select 'other', a.id from a join b on b.id = a.id where abs(a.cost - b.cost) > 0.01 and not exists (select 1 from e where e.id = a.id)""")
def q21b_verify_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What else changed."""
    expected, before, after = exports(spark, sf_dir)
    new = verify.new_products(before, after).select(F.lit("new").alias("kind"), "id")
    twice = verify.repeated_names(before, after).select(F.lit("repeated").alias("kind"), "id")
    other = verify.other_changes(expected, before, after).select(F.lit("other").alias("kind"), "id")
    return new.unionByName(twice).unionByName(other)


@query("""select event_type, count(*) as n, count(*) filter (where value > 50) as high, count(distinct user_id) as users, max(event_id) as last_event from events group by 1""")
def q37_source_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.countDistinct("user_id").alias("users"), F.max("event_id").alias("last_event"))


@query("""select cast(json_extract(props, '$.k') as bigint) as k, count(*) as n, min(event_id) as first_event from events group by 1""")
def q35_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State kept as JSON."""
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""with v as (select o_orderkey, case when o_orderkey % 3 = 0 then 'verificado' else 'no se aplicó' end state from orders where o_orderstatus = 'F' and o_orderkey % 4 <> 0)
select o.o_orderkey, case when o.o_orderstatus = 'F' then coalesce(v.state, 'generado') else 'sin cambio' end as state from orders o left join v on v.o_orderkey = o.o_orderkey""")
def q38_history_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one generation take the state that the check found."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "generado").otherwise("sin cambio").alias("estado"))
    found = orders.filter("estado = 'generado' and o_orderkey % 4 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "verificado").otherwise("no se aplicó").alias("found"))
    return verify.checked_history(orders, found, "o_orderkey").select("o_orderkey", F.col("estado").alias("state"))


@query(f"""with {EXPORTS}, c as (select e.id, case when abs(a.cost - e.cost) <= 0.01 then 1 else 0 end ok from e left join a on a.id = e.id)
select (select cast(sum(ok) as bigint) from c) as ok, (select count(*) from c) as total, (select count(*) from b) as "before", (select count(*) from a) as "after", (select count(*) from a where not exists (select 1 from b where b.id = a.id)) as "new",
 (select sum(ok) = count(*) from c) and (select count(*) from a where not exists (select 1 from b where b.id = a.id)) = 0 as all_well""")
def q50_verify_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the check's totals."""
    expected, before, after = exports(spark, sf_dir)
    return verify.totals(verify.verify(expected, before, after), before, after)


@query("""with h as (select o_orderkey as seq, cast(cast(o_orderdate as date) as varchar) as fecha, case when o_orderkey % 5 = 0 then 'sin cambio' else 'generado' end as estado from orders)
select seq, fecha from h where estado = 'generado' and fecha = (select max(fecha) from h where estado = 'generado')""")
def q51_last_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last generation sent."""
    history = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").cast("string").alias("fecha"), F.when(F.col("o_orderkey") % 5 == 0, "sin cambio").otherwise("generado").alias("estado"))
    return output.last_import(history).select("seq", "fecha")


@query("""select o_orderkey as seq, cast(cast(o_orderdate as date) as varchar) as fecha from orders order by o_orderkey desc limit 200""")
def q52_history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of the history; the number is the feature."""
    history = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").cast("string").alias("fecha"))
    return output.history_tail(history, 200)


@query("""with s as (select 'f' || (o_custkey % 50) as origen, o_orderkey, o_orderstatus from orders), l as (select 'f' || (o_custkey % 50) as origen, count(*) filter (where l_returnflag <> 'N') as prices, count(distinct o_orderkey) as rd from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus <> 'P' group by 1),
c as (select 'f' || (c_custkey % 50) as origen, count(*) as articles from customer group by 1)
select coalesce(s.origen, l.origen, c.origen) as origen, coalesce(messages, 0) as messages, coalesce(again, 0) as again, coalesce(rd, 0) as "read", coalesce(prices, 0) as prices, coalesce(articles, 0) as articles
from (select origen, count(*) as messages, count(*) filter (where o_orderstatus = 'P') as again from s group by 1) s full join l on l.origen = s.origen full join c on c.origen = coalesce(s.origen, l.origen)""")
def q53_cycle_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: messages, priced lines and articles of each source."""
    origin = lambda k: F.concat(F.lit("f"), F.col(k) % 50)
    orders = table(spark, sf_dir, "orders").withColumn("origin", origin("o_custkey")).withColumn("kind", F.lit("planilla"))
    lines = table(spark, sf_dir, "lineitem").join(orders.filter("o_orderstatus <> 'P'"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("origin").alias("origen"), F.col("o_orderkey").alias("huella"), F.when(F.col("l_returnflag") == "N", "faltante").otherwise("costo").alias("tipo"))
    articles = table(spark, sf_dir, "customer").select(origin("c_custkey").alias("origen"))
    return output.source_counters(orders, orders.filter("o_orderstatus = 'P'"), lines, articles)


@query("""select p_partkey, 'item ' || (p_partkey % 90 + 10) || ' g ' || p_brand as renamed from part""")
def q54_renamed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product's size in its name gives way to the quote's."""
    p = table(spark, sf_dir, "part")
    name, quoted = F.concat(F.lit("item 500 gr. "), "p_brand"), F.concat(F.lit("Algo x "), F.col("p_partkey") % 90 + 10, F.lit(" grs"))
    return p.select("p_partkey", F.regexp_replace(with_size(name, normalize_quoted([])(quoted)), r"g\. ", "g ").alias("renamed"))


@query("""select p_partkey, 'Snacks de verdura ' || p_name as line, case when p_partkey % 3 = 0 then '1' || p_partkey || ',50' when p_partkey % 3 = 1 then 7000 + p_partkey || '' else '' end as price from part""")
def q55_list_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaced-out letters, and the price in a cell that the page split."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    cell = F.when(k % 3 == 0, F.concat(F.lit("3 tapas x 12 un. $1 "), k, F.lit(",50"))).when(k % 3 == 1, F.concat(F.lit("a "), (7000 + k).cast("string"))).otherwise("sin precio")
    return p.select("p_partkey", joined_letters(F.concat(F.lit("S n a c k s de verdu R ra "), "p_name")).alias("line"), N.price_in_cell(cell).alias("price"))


@query("""with new as (select s_suppkey as k, 'new ' || s_name as v from supplier where s_suppkey % 2 = 0 union all select s_suppkey + 1000000000, s_name from supplier where s_suppkey % 5 = 0),
old as (select s_suppkey as k, s_name as v from supplier) select k, v from old where not exists (select 1 from new where new.k = old.k) union all select k, v from new""")
def q39_upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M6: the last decision on a key wins."""
    s = table(spark, sf_dir, "supplier")
    seq = F.col("s_suppkey").alias("seq")
    old = s.select(seq, F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    new = s.filter("s_suppkey % 2 = 0").select(seq, F.col("s_suppkey").alias("k"), F.concat(F.lit("new "), "s_name").alias("v"))
    new = new.unionByName(s.filter("s_suppkey % 5 = 0").select(seq, (F.col("s_suppkey") + 1000000000).alias("k"), F.col("s_name").alias("v")))
    return memory.upsert(old, new, ["k"]).select("k", "v")


@query("""with old as (select distinct o_custkey as k from orders where o_orderstatus = 'F'), new as (select distinct c_custkey as k from customer) select k from old union all select k from new where not exists (select 1 from old where old.k = new.k)""")
def q39b_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, M7: keys that are there stay as they are."""
    old = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct().withColumn("seq", F.col("k"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("seq"))
    return memory.insert_absent(old, new, ["k"]).select("k")


@query("""with t as (select case when p_partkey % 9 = 0 then 'bad id' else 'part.p' || (p_partkey - (p_partkey % 8 = 0)::int) end as id, case when p_partkey % 21 = 0 then 0.0 else p_retailprice end as standard_price from part)
select (select cast(coalesce(sum(n), 0) as bigint) from (select count(*) n from t group by id having count(*) > 1)) as repeated_ids, count(*) filter (where not regexp_matches(id, '^[A-Za-z_]\\w*\\.[\\w.\\-]+$')) as bad_ids, count(*) filter (where standard_price <= 0) as bad_costs, count(*) as total_rows from t""")
def q40_import_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2."""
    k = F.col("p_partkey")
    ids = F.when(k % 9 == 0, "bad id").otherwise(F.concat(F.lit("part.p"), k - (k % 8 == 0).cast("int")))
    return verify.gate(table(spark, sf_dir, "part").select(ids.alias("id"), F.when(k % 21 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("standard_price")))


@query("""with d as (select o_orderkey, cast(o_orderdate as date) dt from orders), m as (select max(dt) as_of from d)
select o_orderkey, cast(case when date_diff('day', dt, as_of) > 60 then date_diff('day', dt, as_of) // 30 end as bigint) as months_old from d cross join m""")
def q42_stale_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The age warning of lists, from a given day."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    as_of = orders.agg(F.max("day").alias("as_of"))  # one row
    return orders.crossJoin(F.broadcast(as_of)).select("o_orderkey", N.stale_months(F.col("day"), F.col("as_of")).cast("long").alias("months_old"))


@query("""select coalesce(l_returnflag, 'all') as flag, coalesce(l_linestatus, 'all') as status, count(*) as n, cast(sum(cast(round_even(l_extendedprice * 100, 0) as bigint)) as bigint) as total_cents from lineitem group by cube (l_returnflag, l_linestatus)""")
def q43_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra: totals over all sides of a report."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", N.cents(F.col("l_extendedprice")).alias("c"))
    out = rows.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("c").alias("total_cents"))
    return out.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "total_cents")
