"""Price lists to articles.

Lists of text lines are read by relational steps over all lists at once: four line grammars in order,
the section's brand carried forward, a vote on the decimal mark per list, first-wins dedup.
Tables are cells (:mod:`pricelode.sources.cells`); their columns are found for all files at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.constants import GENERIC_SECTIONS
from pricelode.functions import phrases as P
from pricelode.functions.numbers import decimal_signal, list_number
from pricelode.functions.text import normalize
from pricelode.operators.ordering import first_per, top_per
from pricelode.sources import cells
from pricelode.storage import kept

ARTICLE = "source_id long, line_no long, code string, repeated_code string, description string, brand string, section string, price double, previous double, no_stock boolean, line string"


def tidy(c: Column) -> Column:
    """Offer marks, notes on cases and spare spaces go."""
    for pattern, text in P.LIST_NOISE:
        c = F.regexp_replace(c, pattern, text)
    return F.regexp_replace(F.regexp_replace(c, r"\s{2,}", " "), r"^[ \-.]+|[ \-.]+$", "")


def joined_digits(c: Column) -> Column:
    """T17: "1 4.294" is one number that the page split; else the first number stands."""
    split = c.rlike(r"^\d{1,3}\s+\d{1,3}(?:[.,]\d+)+(\s|$)")
    return F.when(split, F.concat(F.regexp_extract(c, r"^(\S+)", 1), F.regexp_extract(c, r"^\S+\s+(\S+)", 1))).otherwise(F.regexp_extract(c, r"^(\S+)", 1))


def vote(df: DataFrame, price: str) -> DataFrame:
    """Each source's decimal mark: the first strong signal by line, then a weak one, then a comma."""
    signal = decimal_signal(F.col(price))
    weak = F.when(F.col(price).rlike(r",\d{1,2}$"), ",")
    return df.groupBy("source_id").agg(F.coalesce(F.min_by(signal, F.when(signal.isNotNull(), F.col("line_no"))), F.max(weak), F.lit(",")).alias("mark"))


def known(names: DataFrame) -> DataFrame:
    """key, canonical of the names that may stand for a brand in a list."""
    return names.filter(~F.col("key").isin(*GENERIC_SECTIONS)).select("key", "canonical")


def without_repeated_codes(articles: DataFrame) -> DataFrame:
    """A5: a code that a list uses for several products identifies none of them."""
    keyed = articles.withColumn("_key", normalize("description"))
    several = keyed.filter("code <> ''").groupBy("source_id", "code").agg(F.countDistinct("_key").alias("_n")).filter("_n > 1").drop("_n")
    out = keyed.drop("_key").join(several.withColumn("_twice", F.lit(True)), ["source_id", "code"], "left")
    twice = F.coalesce("_twice", F.lit(False))
    return out.withColumn("repeated_code", F.when(twice, F.col("code")).otherwise("")).withColumn("code", F.when(twice, "").otherwise(F.col("code"))).drop("_twice")


def trailing_brand(articles: DataFrame, names: DataFrame) -> DataFrame:
    """The last three, two or one upper-case words, where they are exactly a known brand."""
    words = F.split(F.trim("description"), r"\s+")
    tails = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.when(F.size(words) > k + 1, F.array_join(F.slice(words, -k, k), " ")).alias("tail")) for k in (3, 2, 1))))
    found = articles.select("source_id", "line_no", tails.alias("x")).select("source_id", "line_no", "x.*")
    found = found.filter((F.col("tail") == F.upper("tail")) & F.col("tail").rlike(r"\p{Lu}")).withColumn("key", normalize("tail")).join(known(names), "key")
    best = top_per(found, ["source_id", "line_no"], [F.col("k").desc()]).select("source_id", "line_no", "k", F.col("canonical").alias("_brand"))
    out = articles.join(best, ["source_id", "line_no"], "left")
    cut = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - F.coalesce("k", F.lit(0)), F.lit(1))), " ")
    return out.withColumn("description", F.when(F.col("k").isNotNull(), cut).otherwise(F.col("description"))).withColumn("brand", F.coalesce("_brand", F.lit(""))).drop("k", "_brand")


def text_articles(lines: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles of list lines (source_id, line_no, line), and the lines that look like one but weren't read.

    names: key, canonical. Null lines are no articles."""
    line = F.col("line")
    rows = lines.filter(line.isNotNull())
    parts = [F.when(line.rlike(g), F.struct(F.lit(n).alias("grammar"), *(F.regexp_extract(line, g, i + 1).alias(f) for i, f in enumerate(("barcode", "code", "description", "previous", "price"))))) for n, g in P.GRAMMARS]
    rows = rows.withColumn("x", F.coalesce(*parts))
    short = (F.col("x").isNull()) & ~line.rlike(P.LOOKS_LIKE_ARTICLE) & (F.size(F.split(F.trim(line), r"\s+")) <= 4)
    titles = rows.filter(short).select("source_id", "line_no", normalize("line").alias("key")).join(known(names), "key").select("source_id", "line_no", F.col("canonical").alias("title"))
    before = Window.partitionBy("source_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(titles, ["source_id", "line_no"], "left").withColumn("section", F.coalesce(F.last("title", ignorenulls=True).over(before), F.lit("")))
    unread = rows.filter(F.col("x").isNull() & line.rlike(P.LOOKS_LIKE_ARTICLE) & ~line.contains("*****")).select("source_id", "line_no", F.trim("line").alias("line"))
    raw = rows.filter("x is not null").select("source_id", "line_no", F.trim("line").alias("line"), "section", "x.*")
    raw = raw.withColumn("price", F.when(F.col("grammar") == "pesos", joined_digits(F.col("price"))).otherwise(F.col("price")))
    raw = raw.withColumn("description", F.when(F.col("grammar") == "net", F.regexp_replace("description", P.PALLET, " ")).otherwise(F.col("description")))
    raw = raw.join(vote(raw, "price"), "source_id")
    stock = F.col("description").rlike(P.NO_STOCK)
    read = raw.select(
        "source_id", "line_no", F.upper(F.when(F.col("code") != "", F.col("code")).otherwise(F.col("barcode"))).alias("code"), F.regexp_replace("description", P.NO_STOCK, " ").alias("description"), "section",
        list_number(F.col("price"), F.col("mark")).alias("price"), F.when(F.col("grammar") == "percent", list_number(F.col("previous"), F.col("mark"))).alias("previous"), stock.alias("no_stock"), "line",
    )
    read = first_per(read.filter(F.col("price").isNotNull() & ((F.col("price") > 1) | F.col("no_stock"))), ["source_id", "code", "price"], "line_no")
    read = read.withColumn("previous", F.when(F.col("previous") < F.col("price"), F.col("previous")))
    read = without_repeated_codes(trailing_brand(read, names).withColumn("description", tidy(F.col("description"))))
    return read.select(*(c.split()[0] for c in ARTICLE.split(", "))), unread


# --- tables


def first_sheets(files: DataFrame) -> DataFrame:
    """Cells of the first sheet of each file (source_id, name, content), written once: they are read several times."""

    def first(name: str, content: bytes) -> list[tuple[str, list[list[str]]]]:
        from pricelode.sources.office import table_rows

        return [("", table_rows(name, content))]

    return kept(cells.file_cells(files, first), "cells")


def table_articles(files: DataFrame, names: DataFrame) -> DataFrame:
    """Articles of table files (source_id, name, content): xlsx, or CSV with any separator.

    Tasks read files to cells; header, columns and lines are found for all files at once (:mod:`pricelode.sources.cells`). A file without a price column has no articles."""
    return cell_articles(first_sheets(files), names)


def cell_articles(sheet: DataFrame, names: DataFrame) -> DataFrame:
    """Articles of tables given as cells (source_id, tab_no, row_no, col, value); line_no counts on through a source's tables, 2**24 for each."""
    raw = kept(cells.table_lines(sheet), "table-lines")
    raw = raw.withColumn("line_no", F.shiftleft(F.col("tab_no").cast("long"), 24) + F.col("line_no")).drop("tab_no")
    raw = raw.join(vote(raw, "price"), "source_id").withColumn("price", list_number(F.col("price"), F.col("mark"))).filter("price > 1")
    exact = raw.withColumn("key", normalize("brand")).join(names.select("key", F.col("canonical").alias("_c")), "key", "left")
    read = exact.select("source_id", "line_no", "code", tidy(F.col("description")).alias("description"), F.coalesce("_c", F.lit("")).alias("brand"), F.lit("").alias("section"), "price", F.lit(None).cast("double").alias("previous"), F.lit(False).alias("no_stock"), "line")
    return without_repeated_codes(read).select(*(c.split()[0] for c in ARTICLE.split(", ")))
