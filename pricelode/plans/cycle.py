"""A whole cycle: sources to lines, lines to products, products to an import table (L5-L8, L11-L14, K1, K6, P13, 2.14).

``Store`` holds the memory tables; ``run_cycle`` returns the named frames of a cycle; ``decide`` turns an
answer into memory. All tables are DataFrames; each big step is a join or a grouping.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode import constants as K
from pricelode.functions.numbers import case_suggested, money, unchanged, variation
from pricelode.functions.text import code_key, fingerprint, normalize, normalize_quoted, row_key, with_size
from pricelode.operators import classify, matching, memory, output, providers, transform
from pricelode.operators.alike import name_pairs
from pricelode.operators.ordering import first_per, latest_value, winners
from pricelode.sources.messages import read_messages
from pricelode.storage import finished, fresh_path, kept, subfolders

SOURCE = "source_id long, kind string, origin string, supplier string, text string, seq long"


#: Decisions after which a table's log is folded into the table.
FOLD_AFTER = 50
#: Rows of one decision at most.
DECISION_ROWS = 1_000_000


@dataclass
class Store:
    """Memory by table name; missing tables are empty.

    A decision is appended to its table's log and nothing else is written; :meth:`read` is the table with the log's decisions on it, the last
    one of a key winning. After ``FOLD_AFTER`` decisions the log is folded into a new table. With a ``path`` all of it stays there: a store
    that is opened on it again goes on where the other one stopped. A fold that broke off is never read. One writer at a time has a store."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    path: str | None = None
    logs: dict[str, tuple[int, str, int]] = field(default_factory=dict)
    folds: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.resumed = resumed = self.path is not None
        self.path = self.path or fresh_path(self.spark, "store")
        for name in memory.TABLES if resumed else ():
            done = [int(x.removeprefix("table-")) for x in subfolders(self.spark, f"{self.path}/{name}") if x.startswith("table-") and finished(self.spark, f"{self.path}/{name}/{x}")]
            if done:
                self.folds[name] = max(done)
                self.tables[name] = self.spark.read.schema(memory.schema_of(name)).parquet(self._at(name, "table"))
            if f"log-{self.folds.get(name, 0)}" in subfolders(self.spark, f"{self.path}/{name}"):
                last = self._log(name).agg(F.max(F.struct("batch", "op")).alias("x"), F.count_distinct("batch").alias("n")).first()
                if last["x"]:
                    self.logs[name] = (last["x"]["batch"], last["x"]["op"], last["n"])

    def _at(self, name: str, what: str) -> str:
        return f"{self.path}/{name}/{what}-{self.folds.get(name, 0)}"

    def _log(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"batch long, op string, {memory.schema_of(name)}").parquet(self._at(name, "log"))

    def read(self, name: str) -> DataFrame:
        base = memory.aligned(self.tables[name], name) if name in self.tables else memory.empty(self.spark, name)
        return memory.decided(base, self._log(name), self.logs[name][1]) if name in self.logs else base

    def put(self, name: str, rows: list[dict], keys: list[str] | None = None, absent: bool = False) -> None:
        op = "append" if keys is None else "codes" if name == "codigos_proveedor" else f"{'absent' if absent else 'upsert'}:{','.join(keys)}"
        batch, before, n = self.logs.get(name, (0, op, 0))
        if before != op or n >= FOLD_AFTER:
            self.replace(name, self.read(name))
            batch, n = 0, 0
        columns = memory.TABLES[name]
        cells = [(batch + 1, op, (batch + 1) * DECISION_ROWS + i, *(str(r.get(c, "")) for c in columns)) for i, r in enumerate(rows)]
        if not rows or len(rows) > DECISION_ROWS:
            raise ValueError(f"a decision has from one to {DECISION_ROWS} rows")
        new = self.spark.createDataFrame(cells, f"batch long, op string, {memory.schema_of(name)}")
        new.coalesce(1).write.mode("append").parquet(self._at(name, "log"))
        self.logs[name] = (batch + 1, op, n + 1)

    def replace(self, name: str, table: DataFrame) -> None:
        """The table is this one from now on; its log begins anew."""
        at = self.folds.get(name, 0) + 1
        memory.aligned(table, name).write.mode("overwrite").parquet(f"{self.path}/{name}/table-{at}")
        self.folds[name] = at
        self.tables[name] = self.spark.read.schema(memory.schema_of(name)).parquet(self._at(name, "table"))
        self.logs.pop(name, None)

    def view(self, name: str) -> matching.View | None:
        """What the last cycle scored; a store without a path of its own keeps none."""
        return matching.View(self.spark, f"{self.path}/views/{name}") if self.resumed else None

    def setting(self, key: str) -> str:
        row = self.read("ajustes").filter(F.col("clave") == key).orderBy(F.col("seq").desc()).first()
        return row["valor"] if row else ""

    def abbreviations(self) -> list[tuple[str, str]]:
        return [(r["texto"], r["significa"]) for r in self.read("abreviaturas").orderBy("seq").collect()]


def provider_index(catalog: DataFrame, nicknames: DataFrame) -> DataFrame:
    """Key, canonical, seq: first catalog row wins; a nickname points to an indexed name."""
    each = F.posexplode(F.concat(F.array("proveedor"), F.split("marcas", r" \| ")))
    own = catalog.select("seq", F.col("proveedor").alias("canonical"), each.alias("pos", "raw")).select(F.struct("seq", "pos").alias("o"), "canonical", normalize("raw").alias("key")).filter("key <> ''")
    first = own.groupBy("key").agg(F.min_by("canonical", "o").alias("canonical"), F.min("o.seq").alias("seq"))
    nick = nicknames.select(normalize("alias").alias("nick"), normalize("proveedor").alias("key")).filter("nick <> ''").join(first, "key").select(F.col("nick").alias("key"), "canonical", "seq")
    return nick.unionByName(first.join(nick.select("key"), "key", "left_anti"))


def message_lines(sources: DataFrame, index: DataFrame, store: Store, forced: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps 3 and 4: new messages to lines and notes, and the messages that were seen before; what was processed isn't parsed again."""
    spark = store.spark
    done = store.read("procesados").select("huella").distinct()
    again = spark.createDataFrame([(h,) for h in forced], "huella string")
    keyed = sources.filter("kind <> 'lista'").withColumn("huella", F.when(F.col("kind") == "texto", fingerprint(F.col("text"))).otherwise(fingerprint(F.col("supplier"), F.col("text"))))
    fresh = memory.not_processed(keyed, done, ["huella"], again)
    seen = keyed.join(fresh.select("source_id"), "source_id", "left_anti")
    # the sender's canonical name starts its text
    start = F.when(F.col("kind") == "texto", "").otherwise(F.col("supplier"))
    exact = index.select(F.col("key").alias("_k"), F.col("canonical").alias("_c"))
    started = fresh.withColumn("_key", normalize("supplier")).join(exact, F.col("_key") == F.col("_k"), "left")
    pairs = name_pairs(fresh.select(normalize("supplier").alias("name")), index.select(F.col("key").alias("name")), "set", K.PROVIDER_SET)
    near = pairs.join(index.select(F.col("key").alias("r"), "canonical"), "r").groupBy("l").agg(F.max_by("canonical", "score").alias("_near"))
    started = started.join(near, F.col("_key") == F.col("l"), "left").withColumn("start", F.when(start == "", "").otherwise(F.coalesce("_c", "_near", start)))
    started = kept(started.drop("_key", "_k", "_c", "l", "_near", "_l"), "messages")
    parsed = kept(read_messages(started.select("source_id", "start", "text"), index), "parsed")
    about = started.select("source_id", "huella", "origin", F.col("seq").alias("source_order"), F.col("kind").alias("source_kind"), F.col("supplier").alias("sender"))
    rows = parsed.join(about, "source_id")
    lines = _shaped(parsed, about)
    notes = rows.filter("note").select(F.col("supplier").alias("proveedor"), F.col("what").alias("nota"), F.col("line").alias("linea"), "huella", F.col("origin").alias("origen"))
    old = seen.select(F.col("supplier").alias("proveedor"), F.lit("ya procesado: son los mismos precios").alias("nota"), F.substring("text", 1, 120).alias("linea"), "huella", F.col("origin").alias("origen"))
    return lines, notes.unionByName(old), seen


def line_id(source: Column, line: Column) -> Column:
    """A line's number over all sources, in their order; a source id that doesn't fit beside the line's number is refused, for it could be another line's."""
    fits = source.between(0, (1 << 32) - 1) & line.between(0, (1 << 31) - 1)
    return F.when(fits, F.shiftleft(source, 31) + line).otherwise(F.raise_error(F.concat(F.lit("a source id must be from 0 to 2^32 - 1: "), source.cast("string"))).cast("long"))


def _shaped(parsed: DataFrame, about: DataFrame) -> DataFrame:
    rows = parsed.filter("not note").join(about, "source_id")
    source = F.when(F.col("source_kind") == "texto", F.col("block")).otherwise(F.col("sender"))
    return rows.select(
        line_id(F.col("source_id"), F.col("line_no")).alias("line_id"), F.col("supplier").alias("proveedor"), F.col("block").alias("proveedor_bloque"), "description", F.col("cost").alias("price"),
        F.coalesce("month", F.lit("")).alias("mes"), "line", source.alias("fuente"), F.col("origin").alias("origen"), "huella", "source_order", F.col("kind").alias("tipo"), F.lit("").alias("codigo"), F.lit(False).alias("es_lista"),
    )


def matched(lines: DataFrame, catalog: DataFrame, store: Store, bridge: DataFrame) -> DataFrame:
    """Step 5: ignored, general term, alias, code, name: each row takes the first that holds."""
    words = store.abbreviations()
    product = matching.product_columns(catalog)
    rows = lines.withColumn("supplier_key", normalize("proveedor")).withColumn("sender_key", normalize("proveedor_bloque"))
    rows = kept(matching.scope_of(matching.scope_of(rows, "supplier_key", bridge, "scope"), "sender_key", bridge, "block_scope"), "scoped")
    texts = rows.select(F.col("description").alias("text"))
    keys = kept(matching.keys_of(texts, "text", words), "keys")
    pair = lambda s: rows.select(F.col(s).alias("supplier"), F.col("description").alias("text"))
    asked = pair("supplier_key").unionByName(pair("sender_key")).distinct()
    ignored = kept(matching.ignored(asked, keys, store.read("ignorar"), words).groupBy("supplier", "text").agg(F.min("reason").alias("reason")), "ignored")
    alias = kept(matching.alias_matches(asked, keys, store.read("alias"), catalog, words).groupBy("supplier", "text").agg(F.array_sort(F.collect_set("referencia")).alias("refs")), "aliases")
    scoped = rows.select("scope", F.col("description").alias("text")).unionByName(rows.select(F.col("block_scope").alias("scope"), F.col("description").alias("text"))).distinct()
    near = kept(matching.candidates(scoped, keys, bridge, catalog, view=store.view("messages")), "near")
    best = kept(matching.same_named(near).join(matching.alternatives(near, catalog), ["scope", "text"], "left"), "best")
    terms = kept(matching.general_terms(scoped, keys, bridge, catalog), "terms")
    codes = matching.code_matches(rows.select("line"), catalog).withColumnRenamed("referencia", "code_ref")

    def by(side: DataFrame, keys_: dict[str, str], suffix: str) -> DataFrame:
        return side.withColumnsRenamed({c: f"{c}_{suffix}" for c in side.columns}), [F.col(a) == F.col(f"{b}_{suffix}") for a, b in keys_.items()]

    out = rows
    for side, keys_, suffix in (
        (ignored, {"supplier_key": "supplier", "description": "text"}, "i1"), (ignored, {"sender_key": "supplier", "description": "text"}, "i2"),
        (alias, {"supplier_key": "supplier", "description": "text"}, "a1"), (alias, {"sender_key": "supplier", "description": "text"}, "a2"),
        (best, {"scope": "scope", "description": "text"}, "n1"), (best, {"block_scope": "scope", "description": "text"}, "n2"),
    ):
        other, on = by(side, keys_, suffix)
        out = out.join(other, on, "left").drop(*(f"{c}_{suffix}" for c in ("supplier", "text", "scope") if f"{c}_{suffix}" in other.columns))
    out = out.join(codes, "line", "left")
    reason = F.coalesce("reason_i1", "reason_i2")
    refs = F.coalesce("refs_a1", "refs_a2")
    second = (F.coalesce("name_score_n1", F.lit(-1.0)) < K.AUTO_SCORE) & (F.coalesce("name_score_n2", F.lit(-1.0)) > F.coalesce("name_score_n1", F.lit(-1.0)))
    name_ref, score, twin, options, others = (F.when(second, F.col(f"{c}_n2")).otherwise(F.col(f"{c}_n1")) for c in ("name_ref", "name_score", "twin", "options", "alternativas"))
    score = F.when(twin, F.least(score, F.lit(K.AUTO_SCORE - 1.0))).otherwise(score)
    out = out.withColumn("reason", reason).withColumn("refs", refs).withColumn("name_ref", name_ref).withColumn("by_name", score).withColumn("options", options).withColumn("alternativas", F.coalesce(others, F.lit("")))
    out = out.withColumn("moved", (F.col("refs_a1").isNull() & F.col("refs_a2").isNotNull()) | (F.col("refs").isNull() & F.col("code_ref").isNull() & F.coalesce(second, F.lit(False))))
    out = kept(out.select(*rows.columns, "reason", "refs", "name_ref", "by_name", "options", "alternativas", "code_ref", "moved"), "answers")
    notice = F.col("tipo").isin("faltante", "sin cambio")
    listed = out.filter(F.col("reason").isNull() & notice).join(terms.withColumnsRenamed({"scope": "_s", "text": "_t", "referencia": "term_ref", "score": "term_score"}), (F.col("scope") == F.col("_s")) & (F.col("description") == F.col("_t"))).drop("_s", "_t")
    rest = out.join(listed.select("line_id").distinct(), "line_id", "left_anti")
    many = F.size(F.coalesce("refs", F.array().cast("array<string>"))) > 1
    exploded = rest.withColumn("alias_ref", F.explode_outer(F.when(F.col("reason").isNull(), F.col("refs"))))
    ref = F.when(F.col("reason").isNotNull(), F.lit(None).cast("string")).otherwise(F.coalesce("alias_ref", "code_ref", "name_ref"))
    points = F.when(F.col("reason").isNotNull() | F.col("alias_ref").isNotNull() | F.col("code_ref").isNotNull(), 100.0).otherwise(F.coalesce("by_name", F.lit(0.0)))
    via = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("alias_ref").isNotNull(), "alias aprendido").when(F.col("code_ref").isNotNull(), "código interno").when(F.col("name_ref").isNotNull(), "nombre").otherwise("")
    state = F.when(F.col("reason").isNotNull(), "ignorado").when(ref.isNull() | (points < K.DOUBTFUL_SCORE), "sin match").when(points >= K.AUTO_SCORE, "ok").otherwise("revisar")
    single = exploded.withColumn("several", many).withColumn("referencia", F.when(state != "sin match", ref)).withColumn("score", F.rint(points).cast("int")).withColumn("via", via).withColumn("state", state)
    notices = listed.withColumn("several", F.lit(True)).withColumn("referencia", F.col("term_ref")).withColumn("score", F.rint("term_score").cast("int")).withColumn("via", F.lit("término general")).withColumn("state", F.lit("aviso"))
    columns = [*lines.columns, "supplier_key", "sender_key", "moved", "several", "referencia", "score", "via", "state", "options", "alternativas"]
    found = single.select(columns).unionByName(notices.select(columns)).join(product, "referencia", "left")
    conflict = matching.size_conflict(F.col("description"), F.coalesce("nombre_odoo", F.lit("")), words)
    return found.withColumn("desajuste", F.when(F.col("several") | F.col("referencia").isNull(), "").otherwise(conflict))


def matched_list(articles: DataFrame, catalog: DataFrame, store: Store, bridge: DataFrame, index: DataFrame) -> DataFrame:
    """Entry B: articles (with proveedor_bloque, brand, section, code, no_stock ...) to rows like :func:`matched`'s."""
    words = store.abbreviations()
    product = matching.product_columns(catalog)
    codes = store.read("codigos_proveedor").select(normalize("proveedor").alias("c_sender"), code_key(F.col("codigo_proveedor")).alias("c_key"), F.trim("referencia_odoo").alias("code_ref"), F.expr("try_cast(unidades as int)").alias("units"), F.col("seq").alias("c_seq"))
    text = articles.withColumn("text", F.col("description"))
    brand = matching.brand_in_text(text.select("text"), index, words)
    rows = text.join(brand, "text", "left").withColumn("marca", F.coalesce(F.when(F.col("brand") != "", F.col("brand")), F.col("text_brand"), F.col("section"), F.lit("")))
    rows = rows.withColumn("proveedor", F.when(F.col("marca") != "", F.col("marca")).otherwise(F.col("proveedor_bloque"))).withColumn("supplier_key", normalize("marca")).withColumn("sender_key", normalize("proveedor_bloque")).withColumn("key", code_key(F.coalesce("code", F.lit(""))))
    last = codes.groupBy("c_sender", "c_key").agg(F.max_by(F.struct("code_ref", "units"), "c_seq").alias("x")).select("c_sender", "c_key", "x.*")
    rows = rows.join(last, (F.col("sender_key") == F.col("c_sender")) & (F.col("key") == F.col("c_key")) & (F.col("key") != ""), "left").drop("c_sender", "c_key")
    # brands that are already bought from this distributor
    usual = latest_value(store.read("historial").filter("estado <> 'no se aplicó'"), "referencia", "fuente", "seq").select("referencia", normalize("fuente").alias("sender_key"))
    bought = usual.unionByName(codes.filter("code_ref <> ''").select(F.col("code_ref").alias("referencia"), F.col("c_sender").alias("sender_key")))
    known = bought.join(product.select("referencia", "proveedor_odoo"), "referencia").filter("proveedor_odoo <> ''").select("sender_key", normalize("proveedor_odoo").alias("known_key")).distinct()
    rows = kept(rows, "articles")
    looked = rows.filter("code_ref is null and not no_stock")
    own = looked.filter("supplier_key <> ''").select("line_id", F.col("supplier_key").alias("name"))
    others = looked.filter("supplier_key = ''").join(known, "sender_key", "left").select("line_id", F.coalesce("known_key", F.lit("")).alias("name"))
    scope = kept(matching.scope_of(own.unionByName(others), "name", bridge, "scope").join(looked.select("line_id", "text"), "line_id"), "scoped")
    keys = kept(matching.keys_of(rows.select("text"), "text", words), "keys")
    best = kept(matching.candidates(scope, keys, bridge, catalog, view=store.view("lists")), "best")
    ranked = scope.join(best, ["scope", "text"]).groupBy("line_id", "referencia", "seq", "clave").agg(F.max("score").alias("score"))
    top = matching.same_named(matching.top_per(ranked.select(F.lit("").alias("scope"), F.col("line_id").cast("string").alias("text"), "referencia", "seq", "clave", "score"), ["text"], [F.col("score").desc(), F.col("seq")], 3))
    top = top.select(F.col("text").cast("long").alias("line_id"), "name_ref", F.col("name_score").alias("by_name"), "options")
    pair = lambda s: rows.select(F.col(s).alias("supplier"), "text")
    asked = pair("supplier_key").filter("supplier <> ''").unionByName(pair("sender_key")).distinct()
    ignored = kept(matching.ignored(asked, keys, store.read("ignorar"), words), "ignored")
    alias = kept(matching.alias_matches(asked, keys, store.read("alias"), catalog, words).groupBy("supplier", "text").agg(F.collect_set("referencia").alias("refs")), "aliases")
    out = rows.join(top, "line_id", "left")
    for side, column, suffix in ((ignored, "supplier_key", "i1"), (ignored, "sender_key", "i2"), (alias, "supplier_key", "a1"), (alias, "sender_key", "a2")):
        other = side.withColumnsRenamed({c: f"{c}_{suffix}" for c in side.columns})
        out = out.join(other, (F.col(column) == F.col(f"supplier_{suffix}")) & (F.col("text") == F.col(f"text_{suffix}")), "left").drop(f"supplier_{suffix}", f"text_{suffix}")
    refs = F.coalesce("refs_a1", "refs_a2")
    alias_ref = F.when(F.size(F.coalesce(refs, F.array().cast("array<string>"))) == 1, refs[0])
    out = out.withColumn("reason", F.coalesce("reason_i1", "reason_i2")).withColumn("alias_ref", alias_ref)
    refs_known = product.select(F.col("referencia").alias("_ref"))
    out = out.join(refs_known, F.col("code_ref") == F.col("_ref"), "left")
    coded = F.col("code_ref").isNotNull()
    state = (
        F.when(F.col("no_stock"), F.when(F.col("_ref").isNotNull(), "aviso"))
        .when(coded & (F.col("code_ref") == ""), "ignorado").when(coded & F.col("_ref").isNull(), "sin match").when(coded, "ok")
        .when(F.col("reason").isNotNull(), "ignorado").when(F.col("alias_ref").isNotNull(), "ok")
        .when(F.coalesce("by_name", F.lit(0.0)) < K.LIST_SCORE, "fuera de catálogo").otherwise("revisar")
    )
    via = (
        F.when(F.col("no_stock"), "la lista dice sin stock").when(coded & (F.col("code_ref") == ""), "no lo vendemos (código de la lista)").when(coded & F.col("_ref").isNull(), F.concat(F.lit("el código estaba asociado a "), "code_ref", F.lit(", que ya no está en Odoo")))
        .when(coded, "código de la lista").when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("alias_ref").isNotNull(), "alias aprendido").otherwise("nombre")
    )
    points = F.when(coded & F.col("_ref").isNull() & (F.col("code_ref") != ""), 0.0).when(coded | F.col("reason").isNotNull() | F.col("alias_ref").isNotNull() | F.col("no_stock"), 100.0).otherwise(F.coalesce("by_name", F.lit(0.0)))
    out = out.withColumn("state", state).filter("state is not null").withColumn("via", via).withColumn("score", F.rint(points).cast("int"))
    ref = F.when(F.col("state").isin("ok", "revisar", "aviso"), F.coalesce(F.col("_ref"), F.col("alias_ref"), F.col("name_ref")))
    out = out.withColumn("referencia", ref).drop("_ref")
    out = out.withColumn("tipo", F.when(F.col("no_stock"), "faltante").otherwise("costo")).withColumn("codigo", F.coalesce("code", F.lit(""))).withColumn("es_lista", F.lit(True)).withColumn("mes", F.lit(""))
    cased = F.col("units") > 1
    out = out.withColumn("precio_bulto", F.when(cased, F.col("price"))).withColumn("price", F.when(cased, money(F.col("price") / F.col("units"), 4)).otherwise(F.col("price")))
    out = out.withColumn("several", F.lit(False)).withColumn("moved", F.lit(False))
    columns = ["line_id", "proveedor", "proveedor_bloque", "description", "price", "mes", "line", "fuente", "origen", "huella", "source_order", "tipo", "codigo", "es_lista", "supplier_key", "sender_key", "moved", "several", "referencia", "score", "via", "state", "options", "precio_bulto", "units"]
    found = out.select(columns).join(product, "referencia", "left")
    conflict = matching.size_conflict(F.col("description"), F.coalesce("nombre_odoo", F.lit("")), words)
    return found.withColumn("desajuste", F.when(cased | F.col("referencia").isNull(), "").otherwise(conflict))


def costed(rows: DataFrame, store: Store, net_business: bool) -> DataFrame:
    """Steps 6 and 7: taxes, variation, equal costs, case suggestion."""
    priced = (F.col("tipo") == "costo") & F.col("state").isin("ok", "revisar") & ~F.col("several")
    rules = transform.tax_rules(store.read("impuestos"), store.read("proveedores"), store.read("proveedor_alias"))
    work = rows.filter(priced).withColumn("sender_key", F.when(F.col("sender_key") != "", F.col("sender_key")).otherwise(F.col("supplier_key")))
    names = work.select(F.col("supplier_key").alias("name")).unionByName(work.select(F.col("sender_key").alias("name"))).distinct()
    kilo = transform.per_kilo_names(names, store.read("reglas_proveedor"))
    done = transform.apply(work, store.read("impuestos"), rules, kilo, net_business)
    rest = rows.filter(~F.coalesce(priced, F.lit(False))).withColumn("costo_nuevo", F.col("price"))
    out = done.unionByName(rest, allowMissingColumns=True)
    counted = (F.col("tipo") == "costo") & F.col("state").isin("ok", "revisar") & ~F.coalesce("falta_iva", F.lit(False)) & (F.coalesce("costo_actual", F.lit(0.0)) != 0)
    out = out.withColumn("variacion", F.when(counted, variation(F.col("costo_nuevo"), F.col("costo_actual"))))
    out = out.withColumn("state", F.when(counted & unchanged(F.col("costo_nuevo"), F.col("costo_actual")), "sin cambio").otherwise(F.col("state")))
    n = F.expr(r"try_cast(regexp_extract(description, '\\b(\\d{1,3})\\s*[xX]\\s*\\d', 1) as int)")
    hint = F.col("es_lista") & F.coalesce("units", F.lit(1)).__le__(1) & case_suggested(F.coalesce("estimated", "costo_nuevo"), F.when(F.col("costo_actual") != 0, F.col("costo_actual")), n)
    return out.withColumn("sugerir_bulto", F.when(hint, n)).withColumn("costo_por_unidad", F.when(hint, money(F.coalesce("estimated", "costo_nuevo") / n)))


def classified(rows: DataFrame, catalog: DataFrame, store: Store, approved: list[tuple[str, str]], skipped: list[str], source_ok: list[tuple[str, str]]) -> dict[str, DataFrame]:
    """What is ready, what is asked, and the rest."""
    spark = store.spark
    usual = latest_value(store.read("historial").filter("estado <> 'no se aplicó'"), "referencia", "fuente", "seq").withColumnRenamed("fuente", "fuente_habitual")
    ok = store.read("aprobados")
    flag = lambda kinds, name: ok.filter(F.col("tipo").isin(*kinds)).select("referencia").distinct().withColumn(name, F.lit(True))
    pairs = lambda x, name: spark.createDataFrame([(a, b) for a, b in x], "clave_renglon string, referencia string").distinct().withColumn(name, F.lit(True))
    d = rows.withColumn("clave_renglon", row_key(F.col("proveedor_bloque"), F.col("line"), F.col("description"))).join(usual, "referencia", "left")
    d = d.join(flag(["gramaje", "presentacion"], "ok_size"), "referencia", "left").join(flag(["gramaje"], "ok_rename"), "referencia", "left").join(flag(["variacion"], "ok_change"), "referencia", "left")
    d = d.join(pairs(approved, "ok_cycle"), ["clave_renglon", "referencia"], "left").join(pairs(source_ok, "ok_source"), ["clave_renglon", "referencia"], "left")
    d = d.withColumn("_h", normalize(F.coalesce("fuente_habitual", F.lit("")))).withColumn("_f", normalize(F.coalesce("fuente", F.lit(""))))
    distinct = d.select("_h", "_f").distinct().withColumn("_alike", matching.token_set_ratio(F.col("_h"), F.col("_f")))
    d = d.join(distinct, ["_h", "_f"]).withColumn("other", (F.col("_h") != "") & (F.col("_f") != "") & (F.col("_alike") < K.SUPPLIER_SET) & F.col("ok_source").isNull()).drop("_h", "_f", "_alike", "ok_source")
    skip = spark.createDataFrame([(k,) for k in skipped], "clave_renglon string").distinct()
    d = kept(d, "analysis")
    outside = d.filter("state = 'fuera de catálogo'")
    d = d.filter("state <> 'fuera de catálogo'")
    costs = d.filter("tipo = 'costo' and state <> 'ignorado'")
    left_out = costs.join(skip, "clave_renglon", "left_semi")
    costs = costs.join(skip, "clave_renglon", "left_anti")
    word = classify.alert(F.col("state"), F.col("score"), F.col("costo_actual"), F.col("variacion"), F.col("desajuste") != "", F.col("falta_iva"), F.col("other"), F.col("ok_size"), F.col("ok_change"), F.col("ok_cycle"))
    costs = costs.withColumn("alerta", word)
    waits = F.coalesce("falta_iva_proveedor", F.lit(False)) & (F.col("state") != "sin match")
    waiting = costs.filter(waits).withColumn("alerta", F.lit("falta saber si el proveedor cotiza con o sin IVA"))
    costs = costs.filter(~waits)
    good = classify.ready(F.col("alerta"), F.col("state"), F.col("falta_iva"))
    ranked = winners(costs.filter(good), "referencia", [F.col("score").desc(), F.col("source_order").desc(), F.col("line_id")], ["clave_renglon", "line", "costo_nuevo", "origen"])
    ready = ranked.filter("place = 1").drop("place", "win_clave_renglon", "win_line", "win_costo_nuevo", "win_origen")
    losers = ranked.filter("place > 1").drop("place").withColumn("alerta", F.lit("otro renglón matcheó el mismo producto con más confianza"))
    asked = costs.filter(~good & (F.col("state") != "sin cambio")).unionByName(losers, allowMissingColumns=True)
    sized = costs.filter("desajuste <> ''").withColumn("nombre_corregido", F.when(F.col("ok_rename"), with_size(F.col("nombre_odoo"), normalize_quoted(store.abbreviations())("description"))).otherwise(""))
    turn = store.read("rotaciones").select("grupo", F.trim("referencia").alias("referencia")).join(first_per(catalog, ["referencia"]).select("referencia", "publicado", "id_externo", "nombre_completo"), "referencia")
    named = d.filter("referencia is not null").select("referencia").distinct()
    rotation = classify.rotation(turn.join(named.withColumn("_m", F.lit(True)), "referencia", "left"), "grupo", F.col("publicado"), F.col("_m")).drop("_m")
    missing = classify.not_mentioned(catalog, d.select("proveedor", "referencia").filter("referencia is not null").unionByName(d.select("proveedor", F.lit("").alias("referencia"))), "proveedor", "referencia", rotation)
    return {
        "analisis": d, "listos": ready, "confirmar": asked, "sin_cambio": costs.filter("state = 'sin cambio'"), "saltados": left_out, "avisos": d.filter("tipo in ('faltante', 'sin cambio')"),
        "ignorados": d.filter("state = 'ignorado'"), "gramajes": sized, "rotacion": rotation, "no_mencionados": missing, "fuera_de_catalogo": outside, "esperan_iva": waiting,
    }


def run_cycle(catalog: DataFrame, store: Store, sources: DataFrame, articles: DataFrame | None = None, approved=(), skipped=(), source_ok=(), forced=(), factor: float = 1.0) -> dict[str, DataFrame]:
    """L12. sources: :data:`SOURCE`; articles: lists' articles with source columns. factor: P15."""
    net = store.setting("costo_sin_iva") == "si"
    index = provider_index(catalog, store.read("proveedor_alias"))
    index = kept(index, "index")
    lines, notes, seen = message_lines(sources, index, store, list(forced))
    lines = kept(lines.withColumn("price", money(F.col("price") * factor) if factor != 1 else F.col("price")), "lines")
    suppliers = lines.select(normalize("proveedor").alias("name")).unionByName(lines.select(normalize("proveedor_bloque").alias("name")))
    suppliers = suppliers.unionByName(catalog.select(F.col("clave_prov").alias("name"))).unionByName(index.select(normalize("canonical").alias("name")))
    if articles is not None:
        # D3: a row that a list repeats as it stands says nothing new
        articles = first_per(articles, ["fuente", "origen", "code", "description", "price"], "line_id")
        articles = articles.withColumn("price", money(F.col("price") * factor) if factor != 1 else F.col("price"))
        suppliers = suppliers.unionByName(articles.select(normalize("brand").alias("name"))).unionByName(articles.select(normalize("proveedor_bloque").alias("name")))
    bridge = kept(matching.scopes(suppliers.distinct(), catalog), "scopes")
    rows = matched(lines, catalog, store, bridge).withColumn("precio_bulto", F.lit(None).cast("double")).withColumn("units", F.lit(None).cast("int"))
    if articles is not None:
        rows = rows.unionByName(matched_list(articles, catalog, store, bridge, index), allowMissingColumns=True)
    rows = kept(costed(kept(rows, "matched"), store, net), "costed")
    out = classified(rows, catalog, store, list(approved), list(skipped), list(source_ok))
    out["control"] = output.control(out, providers.variable_margin(store.read("proveedores")))
    out["fuentes"] = output.source_counters(sources, seen, lines, articles)
    return out | {"notas": notes, "huellas": lines.select("fuente", "huella", "origen").filter("fuente <> ''").distinct()}


def import_table(result: dict[str, DataFrame]) -> DataFrame:
    """K1: id, default_code, name, standard_price of what is ready; corrected names where approved."""
    names = result["gramajes"].filter("ok_rename and nombre_corregido <> ''").groupBy("referencia").agg(F.max("nombre_corregido").alias("nuevo"))
    return result["listos"].join(names, "referencia", "left").select(F.col("id_externo").alias("id"), "default_code", F.coalesce("nuevo", "nombre_odoo").alias("name"), money(F.col("costo_nuevo")).alias("standard_price"))


def history_rows(result: dict[str, DataFrame], day: str) -> DataFrame:
    """K6: what goes out, and who confirmed an unchanged cost first."""
    columns = [F.lit(day).alias("fecha"), "referencia", F.col("nombre_odoo").alias("producto"), F.col("costo_actual").cast("string").alias("costo_anterior"), F.col("costo_nuevo").cast("string").alias("costo_nuevo"), "fuente", "origen", F.col("line").alias("linea")]
    same = result["sin_cambio"].filter("coalesce(fuente, '') <> '' and coalesce(fuente_habitual, '') = ''")
    return result["listos"].select(*columns, F.lit("generado").alias("estado")).unionByName(same.select(*columns, F.lit("sin cambio").alias("estado")))


@dataclass
class Answers:
    """What was answered for this cycle alone: arguments of :func:`run_cycle`, kept as rows of a table between its runs."""

    approved: set[tuple[str, str]] = field(default_factory=set)
    skipped: set[str] = field(default_factory=set)
    source_ok: set[tuple[str, str]] = field(default_factory=set)
    forced: set[str] = field(default_factory=set)

    def take(self, action: str, row: dict) -> bool:
        """Whether the action is one of this cycle: forzar (a message again), aprobar, fuente_ok, saltar, and restaurar, which takes a skip back."""
        if action == "forzar":
            self.forced.add(row["huella"])
        elif action == "aprobar":
            self.approved.add((row["clave_renglon"], row["referencia"]))
        elif action == "fuente_ok":
            self.source_ok.add((row["clave_renglon"], row["referencia"]))
        elif action == "saltar":
            self.skipped.add(row["clave_renglon"])
        elif action == "restaurar":
            self.skipped.discard(row["clave_renglon"])
        else:
            return False
        return True

    def arguments(self) -> dict[str, list]:
        return {k: sorted(getattr(self, k)) for k in ("approved", "skipped", "source_ok", "forced")}

    def rows(self, spark: SparkSession) -> DataFrame:
        """The answers as a table (kind, key, ref), to be kept with the cycle."""
        flat = [(k, *(x if isinstance(x, tuple) else (x, ""))) for k, xs in self.arguments().items() for x in xs]
        return spark.createDataFrame(flat, "kind string, key string, ref string")

    @classmethod
    def of(cls, table: DataFrame) -> Answers:
        out = cls()
        for kind, key, ref in table.select("kind", "key", "ref").collect():  # what people answered in one cycle
            getattr(out, kind).add((key, ref) if kind in ("approved", "source_ok") else key)
        return out


def decide(store: Store, row: dict, action: str, answer: str = "", answers: Answers | None = None) -> None:
    """2.14: what a person's answer to a row does to the memory, or, for this cycle alone, to ``answers``."""
    if answers is not None and answers.take(action, row):
        return
    if action in ("elegir", "preferir"):
        if row["es_lista"] and row["codigo"]:
            store.put("codigos_proveedor", [{"proveedor": row["proveedor_bloque"], "codigo_proveedor": row["codigo"], "descripcion_proveedor": row["description"], "referencia_odoo": answer, "unidades": ""}], ["proveedor", "codigo_proveedor"])
        else:
            store.put("alias", [{"texto": row["description"], "referencia": answer, "proveedor": row["proveedor"]}], ["texto", "proveedor"])
    elif action == "bulto":
        store.put("codigos_proveedor", [{"proveedor": row["proveedor_bloque"], "codigo_proveedor": row["codigo"], "descripcion_proveedor": row["description"], "referencia_odoo": row["referencia"], "unidades": answer}], ["proveedor", "codigo_proveedor"])
    elif action == "iva_proveedor":
        asked = store.spark.createDataFrame([(row["proveedor_bloque"] or row["proveedor"], answer)], "asked string, iva_lista string")
        cards, taxes = providers.set_tax(asked, store.read("proveedores"), store.read("impuestos"))
        cards, taxes = kept(cards, "cards"), kept(taxes, "taxes")
        store.replace("proveedores", cards)
        store.replace("impuestos", taxes)
    elif action == "iva_producto":
        store.put("impuestos", [{"ambito": "referencia", "clave": row["referencia"], "iva": answer, "percepcion": "0"}], ["ambito", "clave"])
    elif action in ("gramaje", "presentacion", "variacion"):
        store.put("aprobados", [{"referencia": row["referencia"], "tipo": action}], ["referencia", "tipo"], absent=True)
    elif action == "ignorar":
        store.put("ignorar", [{"texto": row["description"], "proveedor": row["proveedor"], "motivo": answer}])
    else:
        raise ValueError(f"unknown action {action}")
