"""Queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricelode.llm import bytecnn, decontam, interactions, linededup, neardup, ngramlr, pieces, pii, repeats, resample, sketches, slots, tokenstore


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op5_range_coded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.report(table(spark, sf_dir, "documents"))


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytecnn.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.shard(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlr.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lookup_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.report(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_array_dedup, op2_dart_minhash, op3_decontamination, op4_line_dedup, op5_range_coded_tokens, op6_byte_cnn, op7_pii, op8_slot_sharding, op9_sentencepiece, op10_quality_rules, op11_filter_interactions, op12_lookup_sketches, op13_importance_resampling)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"

#: The same results for DuckDB. The other operators are held against plain versions in the tests.
ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": f"""with w as (select item_id, {_WORDS} ws from benchmark),
x as (select item_id, unnest(case when len(ws) = 0 then [] when len(ws) < 10 then [ws] else list_transform(range(1, len(ws) - 8), lambda i: ws[i:i + 9]) end) x from w),
iw as (select distinct item_id, len(x) l, array_to_string(x, ' ') k from x),
d as (select doc_id, {_WORDS} ws from documents),
n as (select distinct l from iw),
p as (select doc_id, l, ws, unnest(range(1, len(ws) - l + 2)) p from d, n),
h as (select p.doc_id, iw.item_id, p.p, p.l from p join iw on iw.l = p.l and iw.k = array_to_string(p.ws[p.p:p.p + p.l - 1], ' ')),
hit as (select doc_id, count(distinct q) n from (select doc_id, unnest(range(p, p + l)) q from h) group by 1),
its as (select doc_id, count(distinct item_id) n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) ids from h group by 1)
select d.doc_id, cast(len(d.ws) as bigint) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(its.n, 0) as n_items, sha256(coalesce(its.ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from d left join hit on hit.doc_id = d.doc_id left join its on its.doc_id = d.doc_id""",
    "op4_line_dedup": f"""with t as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select doc_id, unnest(ls) line, generate_subscripts(ls, 1) i from t),
m as (select *, rtrim(line, {_BLANK}) r, rtrim(line, {_BLANK}) <> '' solid from l),
s as (select doc_id, i a, lead(i, 2) over v b, r || chr(10) || lead(r, 1) over v || chr(10) || lead(r, 2) over v k from m where solid window v as (partition by doc_id order by i)),
f as (select *, row_number() over (partition by k order by doc_id, a) n from s where b is not null),
c as (select distinct doc_id, i from (select doc_id, unnest(range(a, b + 1)) i from f where n > 1)),
g as (select m.*, c.i is not null gone from m left join c on c.doc_id = m.doc_id and c.i = m.i),
e as (select *, last_value(case when solid then gone end ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) before,
 first_value(case when solid then gone end ignore nulls) over (partition by doc_id order by i rows between 1 following and unbounded following) after from g),
r as (select doc_id, i, line, gone or (not solid and coalesce(before, false) and coalesce(after, false)) gone from e),
z as (select doc_id, count(*) n_lines, count(*) filter (where gone) n_gone, coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '') kept from r group by 1)
select t.doc_id, case when t.text is null then 0 else z.n_lines end as n_lines, z.n_gone as n_lines_removed, cast(coalesce(length(t.text), 0) - length(z.kept) as bigint) as n_removed, sha256(z.kept) as kept_sha256 from t join z on z.doc_id = t.doc_id""",
    "op11_filter_interactions": r"""with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, min(doc_id) over (partition by t) least from d),
f as (select doc_id, part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
 regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] fails from w),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels where doc_id is not null group by 1),
g as (select part, fails, coalesce(good, 0) good, coalesce(toxic, 0) toxic, count(*) n from f left join l on l.doc_id = f.doc_id group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) c, unnest([1, 2, 3, 4, 5]) i),
o as (select a.c || b.c || c.c || d.c || e.c as filter_order, [a.i, b.i, c.i, d.i, e.i] p from x a, x b, x c, x d, x e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
r as (select g.*, o.filter_order, o.p, coalesce(list_position(list_transform(p, lambda i: fails[i]), true), 6) gone from g, o),
s as (select r.*, step, p[step] own from r, (select unnest([1, 2, 3, 4, 5]) step)),
z as (select part, filter_order, step, own, sum(n) filter (where gone > step) kept, sum(n) filter (where gone = step) removed, sum(n) filter (where fails[own] and gone < step) redundant,
 sum(n) filter (where fails[own] and len(list_filter(fails, lambda q: q)) = 1) unique_fails, sum(n * good) filter (where gone = step) good_lost, sum(n * toxic) filter (where gone = step) toxic_lost from s group by 1, 2, 3, 4)
select part, filter_order, cast(step as integer) as step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(redundant, 0) as bigint) as redundant,
 cast(coalesce(unique_fails, 0) as bigint) as unique_fails, cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
 cast(sum(coalesce(removed, 0)) over (partition by part, own) as bigint) as shapley from z""",
    "op13_importance_resampling": r"""with base as (select doc_id, text, true as own from documents union all select null, text, false from benchmark),
w as (select row_number() over () as r, doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from base),
f as (select r, own, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) f from w),
tab as (select list(c order by n) t from (select n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end) c from (select unnest(range(256))::ubigint n))),
d as (select distinct f from f),
b as (select f, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::ubigint)), lambda c, x: xor(c // 256, t[xor(c % 256, x)::bigint + 1])), 4294967295::ubigint) % 10000 as bucket from d, tab),
n as (select bucket, count(*) filter (where own) s, count(*) filter (where not own) t from f join b on b.f = f.f group by 1),
g as (select bucket, cast(floor(1000 * ln((t + 1)::double * ((select sum(s) from n) + 10000)::double / ((s + 1)::double * ((select sum(t) from n) + 10000)::double))) as bigint) gain from n),
x as (select r, count(*) n_features, cast(floor(sum(gain)::double / count(*)) as bigint) weight from f join b on b.f = f.f join g on g.bucket = b.bucket where own group by 1),
z as (select doc_id, len(ws) >= 20 able, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::varchar, ''))[1:8])::ubigint + 0.5::double) / 4294967296))) as bigint) as score from w left join x on x.r = w.r where own),
y as (select *, row_number() over (partition by able order by score desc, doc_id nulls last) place, count(*) over (partition by able) n from z)
select doc_id, n_features, weight, score, case when able and place <= 25 * n // 100 then place end as rank from y""",
}
