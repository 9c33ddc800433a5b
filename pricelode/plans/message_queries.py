"""Queries of the message operators: fingerprints, lines, headers, titles, splits, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.functions import numbers as N
from pricelode.functions import text as T
from pricelode.operators import matching, memory
from pricelode.operators.alike import name_pairs
from pricelode.plans.registry import query, table
from pricelode.sources import cells, pages, pricelists
from pricelode.sources.messages import gathered, message_lines, read_lines, read_messages
from pricelode.storage import dropped, kept


@query("""select doc_id, sha1(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))[1:16] as fp, count(*) over (partition by sha1(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))[1:16]) as copies from documents""")
def q08_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by fingerprint. Copies are counted with map-side combining, then joined."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fp"))
    return d.join(d.groupBy("fp").agg(F.count("*").alias("copies")), "fp").select("doc_id", "fp", "copies")


@query("""with f as (select doc_id, source, sha1(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))[1:16] as fp from documents), p as (select distinct fp from f where doc_id % 3 = 0), g as (select fp from f where doc_id % 9 = 0)
select doc_id, fp from f where fp not in (select fp from p) or fp in (select fp from g)""")
def q09_idempotent_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what wasn't processed, or was forced."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fp"))
    return memory.not_processed(d, d.filter("doc_id % 3 = 0"), ["fp"], d.filter("doc_id % 9 = 0").select("fp").distinct()).select("doc_id", "fp")


@query("""with m as (select conv_id, turn, role, case when role = 'user' then md5(text) end h from conversations), c as (select conv_id, turn, role, last_value(h ignore nulls) over (partition by conv_id order by turn, role, h rows between unbounded preceding and current row) as header from m)
select conv_id, turn, role, header from c""")
def q24_header_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last header stands until the next."""
    m = table(spark, sf_dir, "conversations").withColumn("h", F.when(F.col("role") == "user", F.md5("text")))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", F.col("h").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.select("conv_id", "turn", "role", F.last("h", ignorenulls=True).over(w).alias("header"))


@query("""with m as (select conv_id, turn, length(text) n, md5(text) h from conversations), l as (select *, lead(n) over (partition by conv_id order by turn, h) nx from m)
select conv_id, turn, h as title, coalesce(n > 40 and nx < n, false) as is_title from l""")
def q25_title_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line is a title by what follows it."""
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"), F.md5("text").alias("title"))
    after = F.lead("n").over(Window.partitionBy("conv_id").orderBy("turn", "title"))
    return m.select("conv_id", "turn", "title", F.coalesce((F.col("n") > 40) & (after < F.col("n")), F.lit(False)).alias("is_title"))


@query("""with s as (select doc_id, string_split(text, chr(10)) ls from documents), l as (select doc_id, unnest(ls) line, generate_subscripts(ls, 1) - 1 as line_no from s)
select doc_id, cast(line_no as bigint) as line_no, md5(line) as line_md5 from l where trim(line) <> '' and not regexp_matches(lower(line), '(imagen omitida|audio omitido|cifrado de extremo)')""")
def q26_message_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 basics, F4: lines of messages without noise."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    keep = (F.trim("line") != "") & ~F.col("line").rlike("(?iu)(imagen omitida|audio omitido|cifrado de extremo)")
    return d.filter(keep).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("line_md5"))


@query("""with l as (select l_orderkey, string_agg('item' || l_partkey || ' $' || cast(cast(l_extendedprice as bigint) as varchar), '  ' order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) msg from lineitem group by 1),
s as (select l_orderkey, regexp_extract_all(msg, 'item\\d+ \\$\\d+') parts from l), u as (select l_orderkey, unnest(parts) part, generate_subscripts(parts, 1) as n from s)
select l_orderkey, cast(n as bigint) as n, regexp_extract(part, 'item(\\d+)', 1)::bigint as item, regexp_extract(part, '\\$(\\d+)', 1)::bigint as price from u""")
def q27_multi_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: several products with their prices on one line."""
    lines = table(spark, sf_dir, "lineitem")
    part = F.concat(F.lit("item"), "l_partkey", F.lit(" $"), F.rint("l_extendedprice").cast("long"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", part.alias("part"))
    message = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["part"]), "  ")
    split = lines.groupBy("l_orderkey").agg(message.alias("msg")).select("l_orderkey", F.posexplode(F.regexp_extract_all("msg", F.lit(r"(item\d+ \$\d+)"), F.lit(1))).alias("n", "part"))
    return split.select("l_orderkey", (F.col("n") + 1).cast("long").alias("n"), F.regexp_extract("part", r"item(\d+)", 1).cast("long").alias("item"), F.regexp_extract("part", r"\$(\d+)", 1).cast("long").alias("price"))


@query("""with t as (select o_orderkey, cast(cast(o_orderdate as date) + interval 10 year as date) d from orders), m as (select max(d) as_of from t)
select o_orderkey, case when o_orderkey % 4 = 0 and o_orderkey % 8 <> 0 then null else d end as list_date from t cross join m""")
def q34_date_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest credible date of a text: impossible, too old and too late ones don't count."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.add_months(F.to_date("o_orderdate"), 120).alias("d"))
    as_of = orders.agg(F.max("d").alias("as_of"))  # one row
    k = F.col("o_orderkey")
    own = F.date_format("d", "d/M/yyyy")
    text = (
        F.when(k % 8 == 0, F.concat(F.lit("lista 31/2/2020 y "), F.translate(own, "/", "-")))
        .when(k % 4 == 0, F.lit("del 31/02/1995, 1/1/1999 y 5/5/2999"))
        .when(k % 4 == 1, F.concat(F.lit("vigente "), own, F.lit(" (antes 1/1/2000)")))
        .otherwise(F.concat(F.lit("precios al "), F.date_format("d", "dd.MM.yyyy")))
    )
    return orders.crossJoin(F.broadcast(as_of)).select("o_orderkey", N.latest_date(text, F.col("as_of")).alias("list_date"))


@query("""select cast(p_size as bigint) as source_id, p_partkey as line_no, cast(10000 + p_partkey as varchar) as code, p_name as description, cast(round_even(p_retailprice * 100, 0) as bigint) as price_cents from part""")
def q44_text_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of text lines, one per size, read back to articles."""
    p = table(spark, sf_dir, "part")
    price = F.translate(F.format_number("p_retailprice", 2), ",.", ".,")
    lines = p.select(F.col("p_size").cast("long").alias("source_id"), F.col("p_partkey").alias("line_no"), F.concat(10000 + F.col("p_partkey"), F.lit(" "), "p_name", F.lit(" $ "), price).alias("line"))
    names = p.select(F.lower("p_brand").alias("key"), F.col("p_brand").alias("canonical")).distinct()
    articles, _ = pricelists.text_articles(lines, names)
    return articles.select("source_id", "line_no", "code", "description", N.cents(F.col("price")).alias("price_cents"))


def supplier_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier "), "s_suppkey").alias("key"), F.concat(F.lit("Supplier "), "s_suppkey").alias("canonical"), F.col("s_suppkey").alias("seq"))


def brand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as known names; a name's key has no signs."""
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("seq"))
    return brands.select(F.lower(F.translate("p_brand", "#", " ")).alias("key"), F.col("p_brand").alias("canonical"), "seq")


def told(rows: DataFrame, source, order: list[str], line) -> DataFrame:
    """One message for each source: the lines of its rows, in order."""
    said = rows.select(source.alias("source_id"), F.struct(*order, line.alias("said")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["said"]), "\n")
    return said.groupBy("source_id").agg(text.alias("text")).select("source_id", F.lit("").alias("start"), "text")


def read_rows(messages: DataFrame, index: DataFrame) -> DataFrame:
    rows = read_messages(messages, index)
    return rows.select("source_id", F.col("line_no").cast("long").alias("line_no"), "note", "supplier", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce(N.cents(F.col("cost")), F.lit(-1)).alias("cost_cents"))


@query("""select 'Supplier ' || l_suppkey as supplier, 'costo' as kind, false as note, count(*) as n, sum(round_even(l_extendedprice, 0)) as total from lineitem group by 1""")
def q45_message_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a supplier's quotes of a day as one message, read back to costs by supplier."""
    quotes = table(spark, sf_dir, "lineitem")
    n = quotes.count()
    # a whole number for each supplier's day (up to the year 9999 and no day at all: fewer than 2^23), of which the supplier can be told
    day = F.coalesce(F.unix_date(F.col("l_shipdate").cast("date")) + (1 << 22), F.lit(0))
    quotes = quotes.select((F.shiftleft(F.col("l_suppkey").cast("long"), 23) + day).alias("source_id"), "l_orderkey", "l_linenumber", "l_partkey", F.rint("l_extendedprice").cast("long").alias("price"))
    lines = gathered(quotes, n, "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    lines = kept(lines.select("source_id", "l_orderkey", "l_linenumber", F.concat("p_name", F.lit(" "), "p_type", F.lit(" $"), "price").alias("said")), "quotes")
    # few lines share a day, so they are moved as they are: lists of a task's own lines would be longer
    order = F.collect_list(F.struct("l_orderkey", "l_linenumber", "said"))
    message = F.array_join(F.transform(F.array_sort(order), lambda x: x["said"]), "\n")  # a supplier's lines of one day
    messages = gathered(lines, n, "source_id").groupBy("source_id").agg(message.alias("text")).select("source_id", F.concat(F.lit("Supplier "), F.shiftright("source_id", 23)).alias("start"), "text")
    # each step's table goes once the next is written
    messages = kept(messages, "messages")
    dropped(lines)
    read = message_lines(messages)
    dropped(messages)
    return read_lines(read, supplier_index(spark, sf_dir)).groupBy("supplier", "kind", "note").agg(F.count("*").alias("n"), F.sum("cost").alias("total"))


@query("""with p as (select cast(p_size as bigint) as source_id, row_number() over (partition by p_size order by p_partkey) - 1 as line_no, p_brand, p_partkey, p_name, p_retailprice from part)
select source_id, line_no, false as note, p_brand as supplier, 'costo' as kind, 'item' || p_partkey || ' ' || p_name as description, cast(round_even(p_retailprice, 0) * 100 as bigint) as cost_cents from p""")
def q47_message_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand's name opens its block, and the price stands alone below each product."""
    p = table(spark, sf_dir, "part")
    line = F.concat(F.upper("p_brand"), F.lit(":\n\U0001f35e - item"), "p_partkey", F.lit(" "), "p_name", F.lit("\n$ "), F.rint("p_retailprice").cast("long"))
    return read_rows(told(p, F.col("p_size").cast("long"), ["p_partkey"], line), brand_index(spark, sf_dir))


@query("""with p as (select *, row_number() over (partition by p_size order by p_partkey) as n from part)
select cast(p_size as bigint) as source_id, 4 * (n - 1) + j as line_no, false as note, '' as supplier, case when j = 2 then 'faltante' else 'costo' end as kind,
 case j when 0 then 'item' || p_partkey || ' rojo x 250 g' when 1 then 'item' || p_partkey || ' rojo x 500 g' when 2 then 'caja' || p_partkey else 'pack' || p_partkey || ' grande picante' end as description,
 case when j = 2 then -1 else cast(round_even(p_retailprice, 0) * 100 + case j when 0 then 0 when 1 then 10000 else 20000 end as bigint) end as cost_cents
from p, (select unnest([0, 1, 2, 3]) as j)""")
def q48_message_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with sizes below, priced lines with variants below, and shortages."""
    p = table(spark, sf_dir, "part")
    price = F.rint("p_retailprice").cast("long")
    line = F.concat(
        F.lit("item"), "p_partkey", F.lit(" rojo\nx 250 g $"), price, F.lit("\nx 500 g: $ "), price + 100, F.lit("\nno hay caja"), "p_partkey", F.lit(" por ahora\nel pack"), "p_partkey", F.lit(" grande $"), price + 200, F.lit(" y\npicante\nnovedad")
    )
    return read_rows(told(p, F.col("p_size").cast("long"), ["p_partkey"], line), brand_index(spark, sf_dir))


@query("""with p as (select *, row_number() over (partition by p_size order by p_partkey) - 1 as n from part)
select cast(p_size as bigint) as source_id, n as line_no, false as note, case when p_partkey % 3 = 0 then '' else p_brand end as supplier, 'costo' as kind, 'item' || p_partkey as description, cast(round_even(p_retailprice * 100, 0) as bigint) as cost_cents from p""")
def q49_message_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of pasted cells, each with its own brand or none; invoices' rows beside them."""
    p = table(spark, sf_dir, "part")
    price = F.translate(F.format_number("p_retailprice", 2), ",.", ".,")
    line = F.concat(F.lit("item"), "p_partkey", F.lit("\t"), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.col("p_brand")), F.lit("\t$ "), price)
    return read_rows(told(p, F.col("p_size").cast("long"), ["p_partkey"], line), brand_index(spark, sf_dir))


@query()
def q46_name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best products for each quoted text within its supplier's scope."""
    p = table(spark, sf_dir, "part")
    catalog = p.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("seq")).select("seq", F.concat_ws(" - ", "p_name", "p_brand").alias("referencia"), F.lower("p_name").alias("clave"), F.col("p_brand").alias("proveedor"), F.lit("").alias("marcas"))
    asked = p.select(F.concat_ws(" ", "p_name", "p_type").alias("text"), F.lower(F.translate("p_brand", "#", " ")).alias("name")).distinct()
    bridge = matching.scopes(asked.select("name"), catalog)
    scoped = matching.scope_of(asked, "name", bridge, "scope")
    keys = matching.keys_of(asked, "text", [])
    return matching.candidates(scoped, keys, bridge, catalog).select("scope", "text", "referencia", F.rint("score").cast("int").alias("score"))


@query("""with l as (select distinct lower(p_name || ' ' || p_type) as l from part), r as (select distinct lower(p_type || ' ' || string_split(p_name, ' ')[-1]) as r from part)
select l, r, 100 as score from l, r where list_has_all(string_split(l, ' '), string_split(r, ' ')) or list_has_all(string_split(r, ' '), string_split(l, ' '))""")
def q56_alike_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of which one has all words of the other, found by words and letters without comparing all."""
    p = table(spark, sf_dir, "part")
    left = p.select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("name"))
    right = p.select(F.lower(F.concat_ws(" ", "p_type", F.element_at(F.split("p_name", " "), -1))).alias("name"))
    return name_pairs(left, right, "set", 100).select("l", "r", F.rint("score").cast("int").alias("score"))


@query("""select cast(p_size as bigint) as page, case when p_size % 2 = 0 and count(*) >= 5 then 398.5 end as cut from part group by 1, p_size""")
def q57_page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of products for each size: those of even sizes have a second column, those of odd ones a price that looks like a code."""
    p = table(spark, sf_dir, "part").withColumn("nth", F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")))
    word = lambda text, x: F.struct(text.alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(x + 45)).alias("x1"))
    code = (F.col("p_partkey") % 90000 + 10000).cast("string")
    words = F.array(word(code, 20), word(F.col("p_name"), 75), word(code, 400), word(F.when(F.col("p_size") % 2 == 0, F.col("p_type")), 455))
    rows = p.select(F.col("p_size").cast("long").alias("page"), F.lit(1000.0).alias("width"), (F.col("nth") * 15.0).alias("top"), F.inline(words)).filter("text is not null")
    return pages.column_cuts(rows)


@query("""with p as (select *, row_number() over (partition by p_size order by p_partkey) - 1 as n from part)
select cast(p_size as bigint) as page, cast(n // 3 as integer) as line, string_agg(p_name || ' $' || replace(cast(p_partkey as varchar), 'O', '0'), '  ' order by n % 3 desc) as text from p group by p_size, n // 3""")
def q58_box_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a photo, three to a line that slopes; letters O for zeros in prices."""
    p = table(spark, sf_dir, "part").withColumn("n", F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")) - 1)
    said = F.concat("p_name", F.lit(" $"), F.replace(F.col("p_partkey").cast("string"), F.lit("0"), F.lit("O")))
    y = F.floor(F.col("n") / 3) * 20.0 + (F.col("n") % 3) * 2.5
    return pages.box_lines(p.select(F.col("p_size").cast("long").alias("page"), y.alias("y"), F.lit(10.0).alias("height"), (100.0 - 10 * (F.col("n") % 3)).alias("x"), said.alias("text")))


@query("""with p as (select *, row_number() over (partition by p_size order by p_partkey) - 1 as n, count(*) over (partition by p_size) as c from part)
select cast(p_size as bigint) as source_id, n as line_no, case when p_size % 3 < 2 then cast(p_partkey as varchar) else '' end as code, 'x ' || p_name as description, case when p_size % 3 < 2 then p_brand else '' end as brand,
 cast(cast(round_even(p_retailprice * 100, 0) as bigint) as varchar) as price from p where p_size % 3 < 2 or c > 1""")
def q59_table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list for each size: with a header, with a title above it and other names, or with none."""
    p = table(spark, sf_dir, "part").withColumn("n", F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")))
    layout = F.col("p_size") % 3
    code, name, price = F.col("p_partkey").cast("string"), F.concat(F.lit("x "), "p_name"), F.rint(F.col("p_retailprice") * 100).cast("long").cast("string")
    row = F.when(layout == 0, F.array(code, name, "p_brand", price)).when(layout == 1, F.array("p_brand", price, code, name)).otherwise(F.array(name, price))
    lines = p.select("p_size", F.when(layout == 2, F.col("n") - 1).otherwise(F.col("n") + F.when(layout == 1, 1).otherwise(0)).alias("row_no"), row.alias("said"))
    labels = lambda *said: F.array(*map(F.lit, said))
    tops = F.when(layout == 0, F.array(labels("Código", "Descripción", "Marca", "Precio"))).when(layout == 1, F.array(labels("LISTA DE OCTUBRE"), labels("Marca", "Importe", "Artículo", "Detalle")))
    above = p.select("p_size").distinct().select("p_size", F.posexplode(tops).alias("row_no", "said"))
    seen = lines.unionByName(above).select(F.col("p_size").cast("long").alias("source_id"), F.lit(0).alias("tab_no"), F.col("row_no").cast("long").alias("row_no"), F.posexplode("said").alias("col", "value"))
    return cells.table_lines(seen).drop("tab_no", "line")


@query("""select cast(p_size as bigint) as book, 'lists' as role, cast(p_partkey + 1 as bigint) as seq, p_brand as supplier, '' as message, '' as checked from part where p_partkey % 3 = 0
union all select p_size, 'messages', p_partkey + 1, p_brand, p_name, 'SI' from part where p_partkey % 3 = 1
union all select p_size, 'manual', p_partkey + 1, p_brand, '', 'x' from part where p_partkey % 3 = 2""")
def q60_book_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book for each size; its tabs of lists, messages, reminders and old messages have unlike columns."""
    p = table(spark, sf_dir, "part")
    tabs = (("PROVEEDOR", "Nos envía"), ("Chequeado", "Mensaje", "Proveedor"), ("Proveedor", "", "¿Chequeado?"), ("Mensaje", "Proveedor"))
    said = (F.array("p_brand", "p_type"), F.array(F.lit("SI"), "p_name", "p_brand"), F.array("p_brand", "p_type", F.lit("x")), F.array("p_name", "p_brand"))
    key = F.col("p_partkey") % 3
    row = F.array(*(F.struct(F.lit(i).alias("tab_no"), s.alias("said")) for i, s in enumerate(said)))
    rows = p.select("p_size", (F.col("p_partkey").cast("long") + 1).alias("row_no"), key.alias("key"), F.inline(row)).filter("tab_no = key or tab_no = 3").drop("key")
    above = p.select("p_size").distinct().select("p_size", F.lit(0).cast("long").alias("row_no"), F.inline(F.array(*(F.struct(F.lit(i).alias("tab_no"), F.array(*map(F.lit, t)).alias("said")) for i, t in enumerate(tabs)))))
    seen = rows.unionByName(above).select(F.col("p_size").cast("long").alias("source_id"), "tab_no", F.lit("").alias("tab"), "row_no", F.posexplode("said").alias("col", "value")).filter("value <> ''")
    return cells.book_rows(seen).select(F.col("source_id").alias("book"), "role", "seq", "supplier", "message", "checked")
