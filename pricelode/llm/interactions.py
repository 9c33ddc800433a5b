"""How five filters of a corpus act together: what each removes in any order, and its fair share of what all remove.

Filters are players of a removal game: the worth of a coalition is the number of documents that fail at least one of its
filters. Documents are reduced to counts by (part, set of failed filters, label) first, so the 32 worths are sums over a
few rows however large the corpus is. The rest follows from them:

* A step's numbers are differences of two coalitions: those before it, and those with its filter.
* A filter's Shapley share is the grand potential minus the potential without it (Hart and Mas-Colell 1989). The potential
  of a coalition S is (worth(S) + the potentials of S without each of its filters) / |S|, from the empty one's 0 on; worths are taken
  120 times, so that every division comes out even and the shares are sums over all orders.

Copies are found by a digest of the text: the least id of a digest is an aggregate with map-side combining, and rows meet it by
(digest, id), a key that no group of copies makes hot.

Defined cases: a null text is empty; a null id is smaller than none and has no smaller one, so it never fails for a copy;
rows of equal id and text don't fail for each other; a null part is the empty string; a document with several label rows
counts as good or toxic where one of them says so; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.llm.storage import picked

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
ORDERS = ["".join(p) for p in permutations(FILTERS)]
WORD = r"[^\x20\x09-\x0D]+"
#: Limits of the filters: words; distinct words and capitals, in hundredths; marks.
MIN_WORDS, DISTINCT, CAPITALS, MARKS = 100, 80, 10, r"[#$%&*|]"


def failures(text: Column) -> Column:
    """The filters that a text fails by itself, one bit each (A 1, B 2, C 4, D 8)."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    chars = F.length(text)
    capitals = chars - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    conditions = [n < MIN_WORDS, 100 * distinct < DISTINCT * n, 100 * capitals > CAPITALS * chars, text.rlike(MARKS)]
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters that they fail, copies included, and by label."""
    text = F.coalesce("text", F.lit(""))
    facts = picked(docs, "doc_id", "text", "lang").select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    facts = facts.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    least = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = picked(labels, "doc_id", "quality", "toxic").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = facts.join(least, ["digest", "doc_id"], "left").join(said, "doc_id", "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << 4).otherwise(0)
    columns = ["part", (F.col("mask") + copy).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")]
    return known.select(*columns, "n").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def worths(cells: DataFrame) -> DataFrame:
    """One row per part: its documents, and the worths of the 32 coalitions in documents, good ones and toxic ones."""

    def of(counted: Column) -> Column:
        return F.array(*(F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, counted)), F.lit(0).cast("long")) for s in range(ALL + 1)))

    n = F.col("n")
    return cells.groupBy("part").agg(F.sum(n).alias("docs"), of(n).alias("v"), of(n * F.col("good")).alias("good"), of(n * F.col("toxic")).alias("toxic"))


def potentials(v: Column) -> Column:
    """120 times the potential of each coalition, in order of the coalitions' bits: every subset comes before its coalition."""

    def grown(p: Column, s: Column) -> Column:
        without = sum((F.when(s.bitwiseAND(1 << i) != 0, F.get(p, s - (1 << i))).otherwise(F.lit(0)) for i in range(len(FILTERS))), F.lit(0))
        return F.array_append(p, F.call_function("div", F.get(v, s) * len(ORDERS) + without, F.bit_count(s)).cast("long"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), grown)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    parts = worths(cells(docs, labels)).withColumn("p", potentials(F.col("v")))
    rows = parts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(ORDERS)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda c: sum((F.when(F.contains(c, F.lit(f)), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumn("before", bits(F.expr("substring(filter_order, 1, step - 1)"))).withColumn("own", bits(F.expr("substring(filter_order, step, 1)")))
    after = F.col("before") + F.col("own")
    gained = lambda name: F.get(name, after) - F.get(name, F.col("before"))
    rest = F.lit(ALL) - F.col("own")
    return rows.select(
        "part", "filter_order", "step", (F.col("docs") - F.get("v", after)).alias("kept"), gained("v").alias("removed"), (F.get("v", F.col("own")) - gained("v")).alias("redundant"),
        (F.get("v", F.lit(ALL)) - F.get("v", rest)).alias("unique_fails"), gained("good").alias("good_lost"), gained("toxic").alias("toxic_lost"),
        (F.get("p", F.lit(ALL)) - F.get("p", rest)).alias("shapley"),
    )
