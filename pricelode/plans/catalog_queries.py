"""Queries of the catalog operators: build, summary, filters, keys, joins by key and by words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.functions import text as T
from pricelode.functions.fuzzy import token_set_ratio, token_sort_ratio
from pricelode.functions.numbers import cents
from pricelode.operators import catalog as C
from pricelode.operators.ordering import first_per, top_per
from pricelode.plans.registry import query, table
from pricelode.sources import cells

RAW = "select p_partkey seq, 'part.' || p_partkey id, p_name || ' - ' || p_type || ' - ' || p_brand name, case when p_partkey % 3 = 0 then '' else 'P' || p_size end code, p_retailprice cost from part"


def raw_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a raw export."""
    p = table(spark, sf_dir, "part")
    code = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("P"), "p_size"))
    return p.select(F.col("p_partkey").alias("seq"), F.concat(F.lit("part."), "p_partkey").alias("id"), F.concat_ws(" - ", "p_name", "p_type", "p_brand").alias("name"), code.alias("code"), F.col("p_retailprice").alias("cost"))


@query(f"""with raw as ({RAW}), r as (select *, row_number() over (partition by name, code order by seq) n from raw)
select id as external_id, case when code <> '' then code else id end as reference, array_to_string(string_split(name, ' - ')[:-2], ' - ') as product,
 string_split(name, ' - ')[-1] as supplier, array_to_string(string_split(name, ' - ')[2:], ' | ') as brands, cast(round_even(cost * 100, 0) as bigint) as cost_cents
from r where n = 1""")
def q01_catalog_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2, P1-P5, D1."""
    raw = raw_parts(spark, sf_dir).withColumnsRenamed({"code": "default_code", "cost": "standard_price"})
    out = C.build_catalog(raw.withColumn("standard_price", F.col("standard_price").cast("string")))
    return out.select(F.col("id_externo").alias("external_id"), F.col("referencia").alias("reference"), F.col("producto").alias("product"), F.col("proveedor").alias("supplier"), F.col("marcas").alias("brands"), cents(F.col("costo_actual")).alias("cost_cents"))


@query(f"""with raw as ({RAW}) select count(*) as products, count(distinct string_split(name, ' - ')[-1]) as suppliers,
 count(*) filter (where code = '') as without_code, count(*) filter (where coalesce(id, '') = '') as without_id from raw""")
def q02_catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2."""
    raw = raw_parts(spark, sf_dir).withColumn("supplier", C.supplier_part(F.col("name")))
    return C.summary(raw, "supplier", "code", "id")


@query("""with p as (select p_partkey, case p_partkey % 7 when 0 then 'Descuento ' || p_name when 1 then '10% ' || p_name when 2 then 'Envío ' || p_name else p_name end as name from part)
select p_partkey, name from p where not regexp_matches(lower(name), '^\\s*(\\$|\\d+\\s*%)|^(descuento|env[ií]o)\\b')
 and not starts_with(lower(strip_accents(name)), (select lower(p_name) from part order by p_partkey limit 1)[1:4])""")
def q03_non_product_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """built-in non-products, and those of the business by a prefix."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 7
    name = F.when(k == 0, F.concat(F.lit("Descuento "), "p_name")).when(k == 1, F.concat(F.lit("10% "), "p_name")).when(k == 2, F.concat(F.lit("Envío "), "p_name")).otherwise(F.col("p_name"))
    named = p.select("p_partkey", name.alias("name"))
    prefix = p.orderBy("p_partkey").limit(1).select(F.substring("p_name", 1, 4).alias("prefix"))
    return C.without_prefixes(named.filter(~C.is_non_product(F.col("name"))), "name", prefix, "prefix")


@query("""with e as (select *, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id) grp from events)
select user_id, cast(grp as bigint) grp, string_agg(distinct event_type, '; ' order by event_type) as tags from e group by all""")
def q04_tag_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events continue the purchase before them."""
    e = table(spark, sf_dir, "events").withColumn("seq", F.struct("ts", "event_id"))
    return C.collapse_tags(e, F.col("event_type") == "purchase", "event_type", ["user_id"], "seq")


@query("""with w as (select doc_id, list_filter(string_split_regex(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9/ ]+', ' ', 'g')), '\\s+'),
 lambda x: x <> '' and x not in ('de','del','la','el','los','las','con','y','en','por','sin','a','para','x')) ws from documents)
select doc_id, md5(array_to_string(list_transform(ws, lambda x: case when length(x) > 4 and x[-1] = 's' and not regexp_matches(x[-2], '[0-9]') then x[:-2] else x end), ' ')) as norm_md5, cast(len(ws) as bigint) as words from w""")
def q05_normalize_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, T2 without sizes, T16, on whole texts."""
    d = table(spark, sf_dir, "documents")
    n = T.normalize_plain(F.col("text"))
    return d.select("doc_id", F.md5(n).alias("norm_md5"), F.when(n == "", 0).otherwise(F.size(F.split(n, " "))).cast("long").alias("words"))


@query("""with p as (select p_partkey, [p_size || 'g', (p_size * 2) || 'cc'] a, case when p_partkey % 4 = 0 then [] else [((p_partkey % 50) + 1) || 'g'] end b from part)
select p_partkey, array_to_string(a, ',') as sizes, len(b) > 0 and not list_has_any(a, b) as conflict from p""")
def q06_size_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6, F13."""
    p = table(spark, sf_dir, "part")
    own = T.sizes(F.concat_ws(" ", F.lit("tin of"), F.concat("p_size", F.lit("g")), F.lit("or"), F.concat(F.col("p_size") * 2, F.lit("cc"))))
    other = T.sizes(F.when(F.col("p_partkey") % 4 == 0, "no size").otherwise(F.concat((F.col("p_partkey") % 50) + 1, F.lit("g"))))
    return p.select("p_partkey", F.array_join(own, ",").alias("sizes"), T.size_conflict(own, other).alias("conflict"))


@query("""select s_suppkey, l.n as quotes, regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') as code from supplier
join (select l_suppkey, regexp_replace(upper('supplier-' || lpad(l_suppkey::varchar, 9, '0')), '[^A-Z0-9]', '', 'g') k, count(*) n from lineitem group by all) l on l.k = regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g')""")
def q07_code_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes agree however they are written. Quotes are counted before the join."""
    s = table(spark, sf_dir, "supplier").withColumn("code", T.code_key(F.col("s_name")))
    quotes = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("quotes"))
    quotes = quotes.select("quotes", T.code_key(F.concat(F.lit("supplier-"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))).alias("code"))
    return s.join(quotes, "code").select("s_suppkey", "quotes", "code")


@query("""with w(name, canonical, prio) as (select 'Supplier ' || s_suppkey, s_name, 0 from supplier union all select 'Supplier ' || s_suppkey, 'nick ' || s_name, 1 from supplier where s_suppkey % 3 = 0),
i as (select lower(name) k, arg_max(canonical, (prio, canonical)) canonical from w group by 1)
select s_suppkey, i.canonical from supplier join i on i.k = lower('supplier ' || s_suppkey)""")
def q28_provider_exact_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 exact, J7: an index by normalized name, where a nickname overrides."""
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("Supplier "), "s_suppkey")
    own = s.select(name.alias("name"), F.col("s_name").alias("canonical"), F.lit(0).alias("prio"))
    nick = s.filter("s_suppkey % 3 = 0").select(name.alias("name"), F.concat(F.lit("nick "), "s_name").alias("canonical"), F.lit(1).alias("prio"))
    index = top_per(own.unionByName(nick).withColumn("k", F.lower("name")), ["k"], [F.col("prio").desc(), F.col("canonical").desc()])
    return s.withColumn("k", F.lower(F.concat(F.lit("supplier "), "s_suppkey"))).join(index.select("k", "canonical"), "k").select("s_suppkey", "canonical")


@query("""with b as (select distinct p_type brand, list_distinct(string_split(lower(p_type), ' ')) bw from part), p as (select p_partkey, string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ') t from part),
m as (select p_partkey, brand, row_number() over (partition by p_partkey order by len(bw) desc, brand) n from p join b on list_has_all(t, bw))
select p_partkey, brand from m where n = 1""")
def q29_brand_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest brand whose words are all in the text. Pairs come from shared words, not a cross product."""
    p = table(spark, sf_dir, "part")
    lower = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    brands = p.select(F.col("p_type").alias("brand")).distinct().withColumn("n", F.size(lower(F.col("brand")))).withColumn("w", F.explode(lower(F.col("brand"))))
    texts = p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t"))
    once = texts.select("t").distinct()  # texts repeat; each is matched once
    hits = once.withColumn("w", F.explode(lower(F.col("t")))).join(brands, "w").groupBy("t", "brand", "n").agg(F.count("*").alias("have")).filter("have = n")
    best = top_per(hits, ["t"], [F.col("n").desc(), F.col("brand")]).select("t", "brand")
    return texts.join(best, "t").select("p_partkey", "brand")


@query("""with c as (select distinct p_name from part), w as (select p_name, unnest(list_distinct(string_split(lower(p_name), ' '))) w from c),
s as (select a.p_name quoted, b.p_name candidate, count(*) score from w a join w b using (w) where a.p_name <> b.p_name group by all),
r as (select *, row_number() over (partition by quoted order by score desc, candidate) place from s)
select quoted, candidate, score, place from r where place <= 3""")
def q30_topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three names that share most words with each, from an index of words."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    words = names.withColumn("w", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))))
    pairs = words.withColumnRenamed("p_name", "quoted").join(words.withColumnRenamed("p_name", "candidate"), "w").filter("quoted <> candidate").groupBy("quoted", "candidate").agg(F.count("*").alias("score"))
    place = F.row_number().over(Window.partitionBy("quoted").orderBy(F.col("score").desc(), "candidate"))
    return pairs.withColumn("place", place.cast("long")).filter("place <= 3")


@query()
def q31_fuzzy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ratios for names that share a word, each pair of distinct names scored once."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    words = names.withColumn("w", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))))
    pairs = words.withColumnRenamed("p_name", "a").join(words.withColumnRenamed("p_name", "b"), "w").filter("a < b").select("a", "b").distinct()
    out = pairs.withColumn("sort", token_sort_ratio(F.lower("a"), F.lower("b"))).withColumn("set", token_set_ratio(F.lower("a"), F.lower("b")))
    return out.withColumn("score", 0.55 * F.col("set") + 0.45 * F.col("sort"))


@query("""with r as (select p_size code, count(distinct lower(p_name)) names, count(*) n from part group by 1)
select p_partkey, case when names > 1 then '' else 'C' || p_size end as code, case when names > 1 then 'C' || p_size else '' end as repeated_code from part join r on r.code = p_size""")
def q32_duplicate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: a code with several descriptions identifies nothing."""
    p = table(spark, sf_dir, "part")
    names = p.groupBy("p_size").agg(F.countDistinct(F.lower("p_name")).alias("names"))
    code, several = F.concat(F.lit("C"), "p_size"), F.col("names") > 1
    return p.join(names, "p_size").select("p_partkey", F.when(several, "").otherwise(code).alias("code"), F.when(several, code).otherwise("").alias("repeated_code"))


@query("""with c as (select 'p_name' f, p_name v from part union all select 'p_brand', p_brand from part union all select 'p_size', p_size::varchar from part union all select 'p_type', p_type from part)
select f as field, cast(count(try_cast(v as double)) * 10000 // count(*) as bigint) as numeric_share, cast(sum(length(v)) as bigint) as total_length, count(*) as n from c group by 1""")
def q33_numeric_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which column holds numbers, which the longest texts."""
    p = table(spark, sf_dir, "part")
    fields = ["p_name", "p_brand", "p_size", "p_type"]
    seen = p.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")).select("x.*")
    return cells.column_shares(seen, ["field"]).select("field", F.floor(F.col("numeric") * 10000 / F.col("n")).cast("long").alias("numeric_share"), "total_length", "n")


@query("""select p_brand, count(*) as n, array_to_string(list(p_name order by p_partkey)[1:3], ' | ') as examples from part group by 1""")
def q36_vat_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each supplier, and the first three. Only three rows of a key are gathered."""
    p = table(spark, sf_dir, "part")
    counts = p.groupBy("p_brand").agg(F.count("*").alias("n"))
    first = top_per(p, ["p_brand"], [F.col("p_partkey").asc()], 3).groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]).alias("x"))
    return counts.join(first, "p_brand").select("p_brand", "n", F.array_join("x", " | ").alias("examples"))


@query("""select 'old' as origin, p_partkey as id, p_name as name, null::varchar as note from part where p_size <= 25
union all by name select 'new' as origin, p_partkey as id, 'n' as note from part where p_size > 25""")
def q41_union_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with different columns, one under the other."""
    p = table(spark, sf_dir, "part")
    old = p.filter("p_size <= 25").select(F.lit("old").alias("origin"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    new = p.filter("p_size > 25").select(F.lit("new").alias("origin"), F.col("p_partkey").alias("id"), F.lit("n").alias("note"))
    return old.unionByName(new, allowMissingColumns=True)


@query("""with a as (select distinct l_partkey k from lineitem where l_returnflag = 'R'), b as (select distinct l_partkey k from lineitem where l_linestatus = 'O')
select 'both' as side, count(*) as n from (select k from a intersect select k from b) union all select 'only_returned', count(*) from (select k from a except select k from b) union all select 'either', count(*) from (select k from a union select k from b)""")
def q41b_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, difference and union of product sets, in one pass of flags."""
    lines = table(spark, sf_dir, "lineitem")
    flags = lines.groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_linestatus") == "O").alias("b"))
    counts = flags.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_returned"), F.count_if(F.col("a") | F.col("b")).alias("either"))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("n")) for c in ("both", "only_returned", "either")))).alias("x")).select("x.*")
