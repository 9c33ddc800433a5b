"""Quoted lines to products: the waterfall as joins.

Every step works on distinct texts within a scope. A supplier's scope is the catalog rows of the names
that are alike to it, or the whole catalog where there are none; scopes are rows of a bridge table. The best products of a
text are exact in either: names that share a word are scored first, then those whose letters leave room for a better score. Names, aliases and ignored texts are found by the pieces that they share
(:mod:`pricelode.operators.alike`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode import constants as K
from pricelode.functions.fuzzy import name_score, token_set_ratio, token_sort_ratio
from pricelode.functions.text import normalize, normalize_quoted, sizes, text_variants
from pricelode.operators import alike
from pricelode.operators.alike import name_pairs
from pricelode.operators.ordering import first_per, last_per, top_per
from pricelode.storage import drop_folder, finished, kept, subfolders

EVERYTHING = "*"
#: Names of a scope that stand in one block.
BLOCK = 5000


def catalog_names(catalog: DataFrame) -> DataFrame:
    """referencia, name: normalized supplier and brands of every product."""
    names = F.array_distinct(F.concat(F.array("proveedor"), F.split("marcas", r" \| ")))
    return catalog.select("referencia", F.explode(names).alias("raw")).filter("raw <> ''").select("referencia", normalize("raw").alias("name"))


def scopes(suppliers: DataFrame, catalog: DataFrame) -> DataFrame:
    """(scope, referencia) for normalized supplier names (name); a name like no product's sees them all.

    The scope ``*`` holds the whole catalog; :func:`scope_of` says which names use it."""
    names = catalog_names(catalog)
    pairs = name_pairs(suppliers, names, "set", K.SUPPLIER_SET)
    own = pairs.join(names, pairs["r"] == names["name"]).select(F.col("l").alias("scope"), "referencia").distinct()
    return own.unionByName(catalog.select(F.lit(EVERYTHING).alias("scope"), "referencia").distinct())


def scope_of(df: DataFrame, column: str, bridge: DataFrame, name: str) -> DataFrame:
    """Adds the scope to search for a row's normalized supplier name."""
    have = bridge.select(F.col("scope").alias(name)).distinct().withColumn("_k", F.col(name))
    return df.join(have, df[column] == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(EVERYTHING)))


def keys_of(texts: DataFrame, text: str, abbreviations: list[tuple[str, str]]) -> DataFrame:
    """(text, key): the normalized variants of each distinct text; keys of under three letters go."""
    once = texts.select(F.col(text).alias("text")).distinct()
    variants = once.withColumn("v", F.explode(text_variants(F.col("text"))))
    return variants.select("text", normalize_quoted(abbreviations)("v").alias("key")).filter(F.length("key") >= 3).distinct()


def products_of(bridge: DataFrame, catalog: DataFrame) -> DataFrame:
    """(scope, referencia, seq, clave) of the products in each scope."""
    return bridge.join(catalog.select("referencia", "clave", "seq"), "referencia").select("scope", "referencia", "seq", "clave")


def _third(scored: DataFrame, texts: DataFrame, k: int, known: DataFrame | None) -> DataFrame:
    """(scope, key, least): the score of the k-th best product that any key of the text has so far; 0 where there are fewer."""
    best = texts.join(scored, ["scope", "key"]).groupBy("scope", "text", "clave").agg(F.max("score").alias("score"))
    best = best if known is None else best.unionByName(known)
    kth = top_per(best, ["scope", "text"], [F.col("score").desc(), F.col("clave")], k).groupBy("scope", "text").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    return texts.join(kth, ["scope", "text"], "left").groupBy("scope", "key").agg(F.min(F.coalesce("least", F.lit(0.0))).alias("least"))


def scored_products(texts: DataFrame, side: DataFrame, k: int, known: DataFrame | None = None) -> DataFrame:
    """(scope, key, clave, score): for each text of ``texts`` (scope, text, key), at least the k best names of its scope, exactly scored.

    ``known`` (scope, text, clave, score) are names outside ``side`` that the texts have already; a name that can't come among their k best isn't scored.

    Names that share a word with a key are scored first. A name that shares none can't score more than the letters that the two have in common
    leave: keys then meet all names of their scope, in blocks, but only those whose bound reaches the k-th best score so far are scored."""
    names = side.select("scope", "clave").distinct()
    asked = texts.select("scope", "key").distinct()
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))).alias("w")
    shared = asked.select("scope", "key", words("key")).join(names.select("scope", "clave", words("clave")), ["scope", "w"]).select("scope", "key", "clave").distinct()
    first = kept(_scored(shared), "scored")
    least = _third(first, texts, k, known)
    marks = kept(alike.marked(names.select(F.col("clave").alias("name")).unionByName(asked.select(F.col("key").alias("name"))), "sort"), "marks")
    named = lambda side: marks.select(F.col("name").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("size", "repeats", *alike.MARKS)))
    blocks = names.groupBy("scope").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    many = names.join(blocks, "scope").withColumn("block", F.pmod(F.xxhash64("clave"), F.col("blocks")).cast("int")).join(named("clave"), "clave").drop("blocks")
    few = least.join(blocks, "scope").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(named("key"), "key").drop("blocks")
    total = F.col("key_size") + F.col("clave_size")
    common = 100 - 100 * alike.letters_apart("key_", "clave_") / total
    bound = F.when(F.col("key_repeats") | F.col("clave_repeats"), 55 + 0.45 * common).otherwise(common)
    more = few.join(many, ["scope", "block"]).filter(bound + 1e-6 >= F.col("least")).select("scope", "key", "clave")
    return first.unionByName(_scored(more.join(first.select("scope", "key", "clave"), ["scope", "key", "clave"], "left_anti")))


def _scored(pairs: DataFrame) -> DataFrame:
    """``pairs`` with their scores; equal keys and names are scored once for all scopes."""
    score = pairs.select("key", "clave").distinct().withColumn("score", name_score(F.col("key"), F.col("clave")))
    return pairs.join(score, ["key", "clave"]).select("scope", "key", "clave", "score")


@dataclass
class View:
    """What a cycle scored, for the next one (L9, L10): numbered folders of three tables below ``path``.

    ``names`` (scope, clave) are the names that were there, ``asked`` (scope, text, digest) the texts and a digest of their keys, ``best`` (scope, text, clave, score)
    each text's k best names, all of a score that the k-th has. ``best`` is written last: a cycle that broke off leaves no view. Two views stay.
    Where the scores themselves change (another version of the library), begin with an empty folder."""

    spark: SparkSession
    path: str

    def _finished(self) -> list[int]:
        each = [int(x) for x in subfolders(self.spark, self.path) if x.isdigit()]
        return sorted(n for n in each if finished(self.spark, f"{self.path}/{n}/best"))

    def read(self) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        n = self._finished()
        return tuple(self.spark.read.parquet(f"{self.path}/{n[-1]}/{t}") for t in ("names", "asked", "best")) if n else None

    def write(self, names: DataFrame, asked: DataFrame, named: DataFrame, k: int) -> None:
        done = self._finished()
        at = f"{self.path}/{done[-1] + 1 if done else 1}"
        best = named.withColumn("_r", F.rank().over(Window.partitionBy("scope", "text").orderBy(F.col("score").desc()))).filter(F.col("_r") <= k).drop("_r")
        for table, name in ((names, "names"), (asked, "asked"), (best, "best")):
            table.write.mode("overwrite").parquet(f"{at}/{name}")
        for n in done[:-1]:
            drop_folder(self.spark, f"{self.path}/{n}")


def _named(texts: DataFrame, scored: DataFrame) -> DataFrame:
    return texts.join(scored, ["scope", "key"]).groupBy("scope", "text", "clave").agg(F.max("score").alias("score"))


def _renewed(texts: DataFrame, names: DataFrame, asked: DataFrame, before: tuple[DataFrame, DataFrame, DataFrame], k: int) -> DataFrame:
    """(scope, text, clave, score) as if all were scored: a text of the last cycle meets only the names that its scope has gained.

    Whoever lost one of its best names, or has other keys than then, is scored anew."""
    old_names, old_asked, old_best = before
    gone, added = old_names.join(names, ["scope", "clave"], "left_anti"), kept(names.join(old_names, ["scope", "clave"], "left_anti"), "added")
    lost = old_best.join(gone, ["scope", "clave"], "left_semi").select("scope", "text").distinct()
    good = kept(asked.join(old_asked, ["scope", "text", "digest"], "left_semi").join(lost, ["scope", "text"], "left_anti").select("scope", "text"), "good")
    same = kept(old_best.join(good, ["scope", "text"], "left_semi"), "same")
    full = kept(texts.join(good, ["scope", "text"], "left_anti"), "full")
    met = kept(texts.join(good, ["scope", "text"], "left_semi").join(added.select("scope").distinct(), "scope", "left_semi"), "met")
    out = same
    for some, side, known in ((full, names, None), (met, added, same)):
        if not some.isEmpty():
            out = out.unionByName(_named(some, kept(scored_products(some, side, k, known), "scored")))
    return out


def candidates(asked: DataFrame, keys: DataFrame, bridge: DataFrame, catalog: DataFrame, k: int = 3, view: View | None = None) -> DataFrame:
    """(scope, text, referencia, score) of the best k products for each asked (scope, text); of equal scores the first row.

    With a ``view`` only what changed since its last cycle is scored, and the view is written for the next one; it holds the texts of one cycle."""
    # read several times each
    texts, side = kept(asked.select("scope", "text").distinct().join(keys, "text"), "asked"), kept(products_of(bridge, catalog).distinct(), "side")
    if view is None:
        named = _named(texts, kept(scored_products(texts, side, k), "scored"))
    else:
        names = kept(side.select("scope", "clave").distinct(), "names")
        digests = kept(texts.groupBy("scope", "text").agg(F.sha2(F.concat_ws("\n", F.lit(k), F.array_sort(F.collect_set("key"))), 256).alias("digest")), "digests")
        before = view.read()
        named = _named(texts, kept(scored_products(texts, names, k), "scored")) if before is None else _renewed(texts, names, digests, before, k)
        named = kept(named, "named")
        view.write(names, digests, named, k)
    # a name may be many products: k of a name's are enough
    few = top_per(side, ["scope", "clave"], [F.col("seq")], k)
    return top_per(named.join(few, ["scope", "clave"]), ["scope", "text"], [F.col("score").desc(), F.col("seq")], k)


def general_terms(asked: DataFrame, keys: DataFrame, bridge: DataFrame, catalog: DataFrame) -> DataFrame:
    """All products under a term, eight at most, which is what the feature shows."""
    longest = keys.groupBy("text").agg(F.max_by("key", F.length("key")).alias("key"))
    side = products_of(bridge, catalog).distinct()
    like = alike.name_pairs(longest.select(F.col("key").alias("name")), side.select(F.col("clave").alias("name")), "set", K.TERM_SET).select(F.col("l").alias("key"), F.col("r").alias("clave"), "score")
    scored = asked.select("scope", "text").distinct().join(longest, "text").join(like, "key").join(side, ["scope", "clave"])
    return top_per(scored, ["scope", "text"], [F.col("score").desc(), F.col("seq")], K.TERM_TOP).select("scope", "text", "referencia", "score")


def in_scope(asked: DataFrame, owned: DataFrame) -> DataFrame:
    """(supplier, owner): whose rows of a memory table each asked supplier is held against; an unknown one ('') against all."""
    suppliers = asked.select("supplier").distinct()
    pairs = name_pairs(suppliers.select(F.col("supplier").alias("name")), owned.select(F.col("owner").alias("name")), "set", K.SUPPLIER_SET)
    return pairs.select(F.col("l").alias("supplier"), F.col("r").alias("owner"))


def alias_matches(asked: DataFrame, keys: DataFrame, alias: DataFrame, catalog: DataFrame, abbreviations: list[tuple[str, str]]) -> DataFrame:
    """(supplier, text, referencia) for asked (supplier, text): all products of the best alias.

    Scope: the supplier's own aliases if it has any, else those of no supplier; all where no supplier is known."""
    a = alias.filter("trim(texto) <> ''").select("referencia", "seq", normalize("proveedor").alias("owner"), normalize_quoted(abbreviations)("texto").alias("alias_key"))
    pairs = in_scope(asked, a)
    # both scores must be high; the stricter one leaves fewer pairs
    like = name_pairs(keys.select(F.col("key").alias("name")), a.select(F.col("alias_key").alias("name")), "set", K.ALIAS_SET).select(F.col("l").alias("key"), F.col("r").alias("alias_key"), F.col("score").alias("set"))
    like = like.withColumn("sort", token_sort_ratio(F.col("key"), F.col("alias_key"))).filter(F.col("sort") >= K.ALIAS_SORT)
    known = pairs.select("supplier").distinct().withColumn("has_own", F.lit(True))
    met = asked.select("supplier", "text").distinct().join(keys, "text").join(like, "key").join(a.withColumnRenamed("owner", "alias_owner"), "alias_key").join(known, "supplier", "left")
    met = met.join(pairs.withColumnRenamed("owner", "alias_owner").withColumn("is_own", F.lit(True)), ["supplier", "alias_owner"], "left")
    good = met.filter((F.col("supplier") == "") | F.col("is_own") | (F.col("has_own").isNull() & (F.col("alias_owner") == "")))
    winner = top_per(good, ["supplier", "text"], [F.col("sort").desc(), F.col("set").desc(), F.col("seq")]).select("supplier", "text", "alias_key")
    found = winner.join(good.select("supplier", "text", "alias_key", "referencia"), ["supplier", "text", "alias_key"]).select("supplier", "text", F.trim("referencia").alias("referencia")).distinct()
    return found.join(catalog.select("referencia").distinct(), "referencia", "left_semi")


def code_matches(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """(line, referencia): the first code-like word of a line that is a product's reference."""
    found = F.regexp_extract_all(F.upper("line"), F.lit(r"\b([A-Z]{2,4}\s?-?\s?\d{3,6})\b"), F.lit(1))
    codes = lines.select("line").distinct().select("line", F.posexplode(F.transform(found, lambda x: F.regexp_replace(x, r"[\s-]", ""))).alias("pos", "referencia"))
    return codes.join(catalog.select("referencia").distinct(), "referencia").groupBy("line").agg(F.min_by("referencia", "pos").alias("referencia"))


def ignored(asked: DataFrame, keys: DataFrame, ignore: DataFrame, abbreviations: list[tuple[str, str]]) -> DataFrame:
    """(supplier, text, reason): texts that the business doesn't sell, unless the sizes differ.

    Rows of no supplier hold for all; where no supplier is known, all rows hold."""
    g = ignore.filter("trim(texto) <> ''").select("seq", F.col("motivo").alias("reason"), normalize("proveedor").alias("owner"), normalize_quoted(abbreviations)("texto").alias("ignore_key"))
    pairs = in_scope(asked, g).withColumn("is_own", F.lit(True))
    once = asked.select("supplier", "text").distinct().withColumn("key", normalize_quoted(abbreviations)("text"))
    like = name_pairs(once.select(F.col("key").alias("name")), g.select(F.col("ignore_key").alias("name")), "sort", K.IGNORE_SORT).select(F.col("l").alias("key"), F.col("r").alias("ignore_key"), "score")
    met = once.join(like, "key").join(g, "ignore_key").join(pairs, ["supplier", "owner"], "left")
    good = met.filter((F.col("supplier") == "") | (F.col("owner") == "") | F.col("is_own"))
    best = top_per(good, ["supplier", "text"], [F.col("score").desc(), F.col("seq")])
    a, b = sizes(F.col("key")), sizes(F.col("ignore_key"))
    clash = (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
    return best.filter(~clash).select("supplier", "text", F.when(F.col("reason") != "", F.col("reason")).otherwise("ignorado").alias("reason"))


def brand_in_text(texts: DataFrame, names: DataFrame, abbreviations: list[tuple[str, str]]) -> DataFrame:
    """(text, brand): the longest known name whose words are all in the text; names: key, canonical, seq."""
    brands = names.filter(F.length("key") >= 4).select("canonical", "seq", F.size(F.array_distinct(F.split("key", " "))).alias("n"), F.explode(F.array_distinct(F.split("key", " "))).alias("w"))
    words = texts.select("text").distinct().select("text", F.explode(F.array_distinct(F.split(normalize_quoted(abbreviations)("text"), " "))).alias("w"))
    hits = words.join(brands, "w").groupBy("text", "canonical", "seq", "n").agg(F.count("*").alias("have")).filter("have = n")
    return top_per(hits, ["text"], [F.col("n").desc(), F.col("seq")]).select("text", F.col("canonical").alias("text_brand"))


def same_named(best: DataFrame) -> DataFrame:
    """The top candidate per (scope, text), its options, and whether the second has the same name."""
    rows = best.groupBy("scope", "text").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "seq", "referencia", "clave"))).alias("x"))  # three at most
    top = F.col("x")[0]
    options = F.transform("x", lambda o: F.struct(o["referencia"].alias("referencia"), F.rint(-o["neg"]).cast("int").alias("score")))
    return rows.select("scope", "text", top["referencia"].alias("name_ref"), (-top["neg"]).alias("name_score"), F.coalesce(F.get("x", F.lit(1))["clave"] == top["clave"], F.lit(False)).alias("twin"), options.alias("options"))


def alternatives(best: DataFrame, catalog: DataFrame) -> DataFrame:
    """(scope, text, alternativas): the candidates after the first, in words."""
    names = first_per(catalog, ["referencia"]).select("referencia", "nombre_completo")
    said = F.concat("referencia", F.lit("="), "nombre_completo", F.lit(" ("), F.rint("score").cast("int").cast("string"), F.lit(")"))
    rows = best.join(names, "referencia").groupBy("scope", "text").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "seq", said.alias("said")))).alias("x"))  # three at most
    return rows.select("scope", "text", F.array_join(F.transform(F.slice("x", 2, 10), lambda o: o["said"]), " | ").alias("alternativas"))


def product_columns(catalog: DataFrame) -> DataFrame:
    """What a matched line takes from its product; of equal references the last row counts."""
    last = last_per(catalog, ["referencia"])
    return last.select("referencia", "id_externo", "default_code", F.col("nombre_completo").alias("nombre_odoo"), "costo_actual", F.col("precio_venta").alias("pv_actual"), "publicado", F.col("proveedor").alias("proveedor_odoo"), "clave")


def size_conflict(quoted: Column, name: Column, abbreviations: list[tuple[str, str]]) -> Column:
    """F13 as a column for supplier text and product name."""
    a, b = sizes(normalize_quoted(abbreviations)(quoted)), sizes(normalize(name))
    clash = (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
    note = F.concat(F.lit("presentación distinta: proveedor "), F.array_join(F.array_sort(a), ", "), F.lit(" / Odoo "), F.array_join(F.array_sort(b), ", "))
    return F.when(clash, note).otherwise("")
