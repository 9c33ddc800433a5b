"""Fingerprints of documents as invertible Bloom lookup sketches of their paragraphs, and what differs between two versions.

A text is the set of its paragraphs (sentences of a line), each a 64-bit digest. A sketch has three rows of cells; a digest goes into
one cell of each row, which keeps how many came, their XOR and the XOR of their check sums. Two sketches of one size subtract cell by cell:
what both texts have vanishes, and a cell that is left with one digest gives it away. Taking that one out of its other two cells lays more
bare (peeling), until all that differs is recovered, with its side. Where peeling stops early the pair is tried again at twice the size.
Likeness is the share of the union of paragraphs that both have, from the recovered differences and the numbers of paragraphs.

The fingerprint is the text's sketch of a fixed size as text, headed by its number of paragraphs; a pair of versions is sketched
in the size that their two numbers call for, so most pairs decode at once.

Everything is DataFrame functions. Cells are rows, a round of peeling is one aggregation, and all versions of a document are in the
partition that its aggregations need, so rounds shuffle nothing. The next document of the table's order is found without sorting in one
place: documents are dealt to ranges of (doc_id, digest), every range also gets the first document of the one after it, and a window runs
within each range. Texts are shuffled once, for that; later steps see digests.

Defined cases: a null text is empty; null ids come first; equal ids are in order of their texts' digests, and rows of equal id and
text follow each other; a paragraph that is repeated counts once; texts without a paragraph are alike (1), one such and another text
are not (0); the only document is its own next; an empty table gives no rows; other columns are ignored. A text of one sentence that is edited has
nothing left in common. Rows of equal id and text are in one range, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.llm.storage import picked, written

#: Ends of paragraphs: white space after a sentence's mark, and ends of lines.
ENDS = r"(?<=[.!?])\s+|\n"
ROWS = 3
#: Cells in a row of a fingerprint; of a pair's sketch: so many, and more for each paragraph of the two.
BASE, MORE = 4, 0.55
#: Rounds of peeling, each of one row of cells.
ROUNDS = 12
RANGE_BYTES = 32 << 20


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.array_remove(F.split(text, ENDS), ""), lambda p: F.xxhash64(p)))


def ranges(keyed: DataFrame, n_bytes: int) -> list[tuple[int, int, int]]:
    """The first key (known, id, h) of each range of documents, in order: one for ``n_bytes`` of text, and for each of the session's partitions."""
    spark = keyed.sparkSession
    keys = keyed.groupBy("known", "id", "h").agg(F.sum(F.octet_length("text")).alias("bytes"))
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // n_bytes + 1)
    dealt = keys.select("known", "id", "h").repartitionByRange(n, "known", "id", "h").withColumn("part", F.spark_partition_id())
    firsts = dealt.groupBy("part").agg(F.min(F.struct("known", "id", "h")).alias("k")).collect()  # a row for each range
    return sorted(tuple(r["k"]) for r in firsts)


def _keys(keys: list[tuple[int, int, int]]) -> str:
    def literal(x: int) -> str:
        return f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"

    return "array(" + ", ".join(f"struct({k} AS known, {literal(i)} AS id, {literal(h)} AS h)" for k, i, h in keys) + ")"


def range_of(key: Column, firsts: list[tuple[int, int, int]]) -> tuple[Column, Column]:
    """Which range a key is in, and whether it is the first there: a search among heads of groups of ranges, then within a group."""
    size = max(1, round(len(firsts) ** 0.5))
    groups = [firsts[i : i + size] for i in range(0, len(firsts), size)]
    group = F.size(F.filter(F.expr(_keys([g[0] for g in groups])), lambda b: b <= key)) - 1
    own = F.get(F.expr("array(" + ", ".join(map(_keys, groups)) + ")"), group)
    within = F.size(F.filter(own, lambda b: b <= key)) - 1
    return group * size + within, F.get(own, within) == key


def followed(docs: DataFrame, n_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per document: range, nth (its place there), doc_id, n_chars, and the text and paragraphs of it and of the next."""
    text = F.coalesce("text", F.lit(""))
    keyed = picked(docs, "doc_id", "text").select(
        "doc_id", text.alias("text"), F.col("doc_id").isNotNull().cast("int").alias("known"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64(text).alias("h"),
    )
    firsts = ranges(keyed, n_bytes) or [(0, 0, 0)]
    place, opens = range_of(F.struct("known", "id", "h"), firsts)
    own = keyed.withColumns({"range": place, "opens": opens})
    last = len(firsts) - 1
    here = F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))
    before = F.struct(F.when(F.col("range") == 0, F.lit(last)).otherwise(F.col("range") - 1).alias("range"), F.lit(1).alias("guest"))
    places = F.when(F.col("opens"), F.array(here, before)).otherwise(F.array(here))
    dealt = own.select("doc_id", "text", "known", "id", "h", F.inline(places)).repartitionById(len(firsts), F.col("range").cast("int"))
    order = Window.partitionBy("range").orderBy("guest", "known", "id", "h")
    rows = dealt.withColumn("own", paragraphs(F.col("text"))).withColumns({"next_text": F.lead("text").over(order), "next": F.lead("own").over(order), "nth": F.row_number().over(order)})
    return rows.filter("guest = 0").select("range", "nth", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", "next_text", "own", "next")


def versions(docs: DataFrame, n_bytes: int = RANGE_BYTES) -> DataFrame:
    """(range, nth, doc_id, n_chars, edited_sha256, own, edited, next): paragraphs of each text, its edited text and the next one."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("next_text").substr(F.lit(1), half))
    rows = followed(docs, n_bytes).withColumn("edited_text", edited)
    return rows.select("range", "nth", "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "own", paragraphs(F.col("edited_text")).alias("edited"), "next")


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def cell(digest: Column, row: int, size: Column, seed: int) -> Column:
    """The place of a digest's cell in one row of a sketch."""
    return row * size + F.pmod(F.xxhash64(digest, F.lit(ROWS * seed + row)), size)


def put(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Cells (keys, size, at, n, x, c) of digests d that come ``sign`` times, in sketches of ``size`` cells a row."""
    at = F.explode(F.array(*(cell(F.col("d"), i, F.col("size"), seed) for i in range(ROWS)))).alias("at")
    cells = rows.select(*keys, "size", "sign", "d", check(F.col("d")).alias("c"), at)
    return cells.groupBy(*keys, "size", "at").agg(F.sum("sign").alias("n"), F.bit_xor("d").alias("x"), F.bit_xor("c").alias("c"))


def peeled(cells: DataFrame, keys: list[str], seed: int, rounds: int = ROUNDS) -> DataFrame:
    """Subtracted cells after peeling: recovered digests stand at -1 with their side (n) and themselves as ``digest``, the rest are cells that are left."""
    group = [*keys, "size", "at", "digest"]
    live = cells.withColumn("digest", F.lit(0).cast("long")).filter("n <> 0 or x <> 0 or c <> 0")
    for turn in range(rounds):
        row = turn % ROWS
        alone = (F.col("at") >= row * F.col("size")) & (F.col("at") < (row + 1) * F.col("size")) & F.col("n").isin(1, -1) & (F.col("c") == check(F.col("x")))
        zero = F.lit(0).cast("long")
        named = lambda at, digest, n, x, c: F.struct(at.cast("long").alias("at"), digest.alias("digest"), n.alias("n"), x.alias("x"), c.alias("c"))
        kept = named(F.col("at"), F.col("digest"), F.col("n"), F.col("x"), F.col("c"))
        found = named(F.lit(-1), F.col("x"), F.col("n"), zero, zero)
        out = [named(cell(F.col("x"), i, F.col("size"), seed), zero, -F.col("n"), F.col("x"), F.col("c")) for i in range(ROWS) if i != row]
        live = live.select(*keys, "size", F.inline(F.when(alone, F.array(found, *out)).otherwise(F.array(kept))))
        live = live.groupBy(*group).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("c").alias("c")).filter("n <> 0 or x <> 0 or c <> 0")
    return live


def sized(n: Column, attempt: int) -> Column:
    return ((2 * BASE + F.ceil(MORE * n)) * (1 << attempt)).cast("long")


def differences(pairs: DataFrame, keys: list[str], attempt: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """For the pairs of sets a and b (keys, a, b) that differ: how many digests only a and only b has, and what was not recovered (stuck).

    Nothing is shuffled where ``pairs`` are partitioned by some of ``keys``. Each attempt has its own places of cells."""
    rows = pairs.withColumn("size", sized(F.size("a") + F.size("b"), attempt)).select(*keys, "size", F.size("a").alias("na"), F.posexplode(F.concat("a", "b")).alias("pos", "d"))
    rows = rows.withColumn("sign", F.when(F.col("pos") < F.col("na"), F.lit(1)).otherwise(F.lit(-1)).cast("long"))
    live = peeled(put(rows, keys, attempt), keys, attempt, rounds)
    return live.groupBy(*keys).agg(
        F.count_if(F.expr("at = -1 and n = 1")).alias("only_a"), F.count_if(F.expr("at = -1 and n = -1")).alias("only_b"), F.count_if(F.expr("at >= 0 or abs(n) <> 1")).alias("stuck"),
    )


def fingerprints(sets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, print): the sketches of sets of digests (keys, a) as text: the number of digests, then the cells that have any."""
    rows = sets.select(*keys, F.lit(BASE).cast("long").alias("size"), F.lit(1).cast("long").alias("sign"), F.explode("a").alias("d"))
    cells = put(rows, keys, 0)
    said = F.concat_ws(".", F.hex("at"), F.hex("n"), F.hex("x"), F.substring(F.hex("c"), -8, 8))
    return cells.groupBy(*keys).agg((F.sum("n") / ROWS).cast("long").alias("digests"), F.array_sort(F.collect_list(said)).alias("cells")).select(*keys, F.concat_ws(":", F.col("digests").cast("string"), F.array_join("cells", ",")).alias("print"))


#: The fingerprint of a text without paragraphs.
NOTHING = "0:"


def alike(n: Column, only_a: Column, only_b: Column) -> Column:
    """Share of the union of a's n paragraphs and b's that both have."""
    union = n + F.coalesce(only_b, F.lit(0))
    return F.when(union == 0, 1.0).otherwise((n - F.coalesce(only_a, F.lit(0))) / union)


def report(docs: DataFrame, n_bytes: int = RANGE_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: its fingerprint and its edited text's, and how like it is to that and to the next document."""
    kept = written(versions(docs, n_bytes), "versions")
    here = kept.repartitionById((kept.agg(F.max("range")).first()[0] or 0) + 1, F.col("range"))
    keys = ["range", "nth", "version"]

    def each(name: str, *columns: str) -> Column:
        return F.inline(F.array(*(F.struct(F.lit(i).alias("version"), F.col(c).alias(name)) for i, c in enumerate(columns))))

    def pairs(rows: DataFrame) -> DataFrame:
        return rows.select("range", "nth", F.col("own").alias("a"), each("b", "edited", "next"))

    sets = here.select("range", "nth", each("a", "own", "edited"))
    blank = {"only_a": "long", "only_b": "long", "stuck": "long", "print": "string"}
    both = lambda df: df.select(*keys, *(c if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in blank.items()))
    found = both(differences(pairs(here), keys, 0, rounds)).unionByName(both(fingerprints(sets, keys)))
    one = lambda c, v: F.max(F.when(F.col("version") == v, F.col(c)))
    first = written(found.groupBy("range", "nth").agg(*(one(c, v).alias(f"{c}_{v}") for v in (0, 1) for c in blank)), "sketched")
    # an unequal text without rows here can't be: a difference leaves recovered digests or cells
    attempt, names = 0, ["only_a", "only_b"]
    stuck = first.select("range", "nth", each("stuck", "stuck_0", "stuck_1")).filter("stuck > 0").drop("stuck")
    again: DataFrame | None = None
    while not stuck.isEmpty():
        attempt += 1
        todo = pairs(kept.join(stuck.select("range", "nth").distinct(), ["range", "nth"], "left_semi")).join(stuck, keys, "left_semi")
        got = written(differences(todo, keys, attempt, rounds), "differences")
        right = got.filter("stuck = 0").select(*keys, *names)
        again = right if again is None else again.unionByName(right)
        stuck = got.filter("stuck > 0").select(*keys)
    if again is not None:
        later = again.groupBy("range", "nth").agg(*(one(c, v).alias(f"again_{c}_{v}") for v in (0, 1) for c in names))
        first = first.join(later, ["range", "nth"], "left").withColumns({f"{c}_{v}": F.when(F.col(f"stuck_{v}") > 0, F.col(f"again_{c}_{v}")).otherwise(F.col(f"{c}_{v}")) for v in (0, 1) for c in names})
    sizes = kept.select("range", "nth", "doc_id", "n_chars", "edited_sha256", *(F.size(c).cast("long").alias(f"n_{c}") for c in ("own",)))
    full = sizes.join(first, ["range", "nth"], "left")
    return full.select(
        "doc_id", "n_chars", "edited_sha256", F.coalesce("print_0", F.lit(NOTHING)).alias("fingerprint"), F.coalesce("print_1", F.lit(NOTHING)).alias("edited_fingerprint"),
        alike(F.col("n_own"), F.col("only_a_0"), F.col("only_b_0")).alias("near_edited"), alike(F.col("n_own"), F.col("only_a_1"), F.col("only_b_1")).alias("near_next"),
    )
