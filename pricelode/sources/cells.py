"""Tables of any number of files as rows of cells.

A task turns a file into its cells and does nothing else. Which row is the header, which column is which field and what a
line says are groupings over the cells of all tables at once; only a header's labels, as many as a table is wide, are ever side by side.

A table is one sheet of a file: (source_id, tab_no). Blank cells are no rows; rows that are all blank aren't counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.constants import HEADER_HINTS
from pricelode.functions.text import folded

TABLE = ["source_id", "tab_no"]
#: Rows below the first one among which a better header may stand.
HEADER_ROWS = 5
#: Rows of a table that are joined together.
CHUNK = 20_000
#: A column without a name is the price if more of its cells than this are numbers.
NUMERIC_SHARE = 0.6
FIELDS = ("precio", "marca", "codigo", "descripcion")

Reader = Callable[[str, bytes], list[tuple[str, list[list[str]]]]]


def file_cells(files: DataFrame, reader: Reader | None = None) -> DataFrame:
    """source_id, tab_no, tab, row_no, col, value of files (source_id, name, content): every sheet of a workbook, or a CSV's one table."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pricelode.sources.office import sheets

        for batch in batches:
            for f in batch.to_pylist():
                out = []
                for tab_no, (tab, rows) in enumerate((reader or sheets)(f["name"] or "", f["content"] or b"")):
                    said = [r for r in ([str(c or "").strip() for c in r] for r in rows) if any(r)]
                    out += [(f["source_id"], tab_no, tab, n, col, c) for n, r in enumerate(said) for col, c in enumerate(r) if c]
                columns = list(zip(*out, strict=True)) if out else [()] * 6
                types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["source_id", "tab_no", "tab", "row_no", "col", "value"])

    return files.select("source_id", "name", "content").mapInArrow(task, "source_id long, tab_no int, tab string, row_no long, col int, value string")


def number(c: Column) -> Column:
    """A cell that is nothing but a number; null for any other."""
    return F.when(F.trim(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(c).cast("double"))


def hinted(label: Column, field: str) -> Column:
    """Whether a label begins like one of the field's names."""
    plain = F.trim(folded(label))
    return F.exists(F.array(*map(F.lit, HEADER_HINTS[field])), lambda p: plain.startswith(p))


def with_facts(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """Cells with what is known of their table (one row for each), and ``chunk``: the rows of a table are dealt in chunks, and its facts go to each.

    Spark takes cells that come from a small file for a small side, which it would send whole to every task; and one large table would be one task's."""
    dealt = cells.withColumn("chunk", F.floor(F.col("row_no") / CHUNK))
    told = dealt.select(*TABLE, "chunk").distinct().join(facts, TABLE)
    return dealt.hint("merge").join(told, [*TABLE, "chunk"])


def headers(cells: DataFrame) -> DataFrame:
    """source_id, tab_no, header: of the first rows the one that names most fields; of equal ones the first."""
    labels = [F.max(hinted(F.col("value"), f).cast("int")).alias(f) for f in ("codigo", "descripcion", "precio")]
    rows = cells.filter(F.col("row_no") <= HEADER_ROWS).groupBy(*TABLE, "row_no").agg(*labels)
    return rows.groupBy(*TABLE).agg(F.max_by("row_no", F.struct(F.col("codigo") + F.col("descripcion") + F.col("precio"), -F.col("row_no"))).alias("header"))


def column_shares(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Numeric (cells that are numbers), total_length and n of the cells of each column."""
    return cells.groupBy(*keys).agg(F.count(number(F.col("value"))).alias("numeric"), F.coalesce(F.sum(F.length("value")), F.lit(0)).cast("long").alias("total_length"), F.count("*").alias("n"))


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that stand as they are: no later step puts their expressions in place of their names, which grows with each step."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _best(used: Column, worth: Callable[[Column], Column]) -> Column:
    """The unused column of the highest worth; of equal ones the leftmost."""
    top = F.array_max(F.transform(F.filter("x", lambda c: ~F.array_contains(used, c["col"])), lambda c: F.struct(worth(c).alias("worth"), (-c["col"]).alias("neg"))))
    return F.struct((-top["neg"]).alias("col"), top["worth"].alias("worth"))


def columns_of(cells: DataFrame) -> DataFrame:
    """source_id, tab_no, first (the first row of data) and the columns precio, marca, codigo, descripcion (null where there is none).

    Names decide, in that order, each taking the leftmost column that is left. Without a named price the most numeric column is it, without a
    named description the longest. Where the label of that price is a number itself, the "header" is the first article:
    it goes back to the data and names decide nothing."""
    seen = with_facts(cells, headers(cells)).filter("row_no >= header")
    names = F.filter(F.array(*(F.when(hinted(F.col("value"), f), F.lit(f)) for f in FIELDS)), lambda f: f.isNotNull())
    label = F.when(F.col("row_no") == F.col("header"), F.struct("value", names.alias("names")))
    body = F.when(F.col("row_no") > F.col("header"), F.col("value"))
    each = seen.groupBy(*TABLE, "header", "col").agg(
        F.max("row_no").alias("last"), F.max(label).alias("label"), F.count(number(body)).alias("numeric"), F.coalesce(F.sum(F.length(body)), F.lit(0)).alias("length")
    )
    said = F.coalesce("label.value", F.lit(""))
    column = F.struct("col", "numeric", "length", said.alias("label"), F.coalesce("label.names", F.array().cast("array<string>")).alias("names"), number(said).isNotNull().cast("int").alias("label_numeric"))
    wide = each.groupBy(*TABLE, "header").agg((F.max("last") - F.col("header")).alias("rows"), F.sort_array(F.collect_list(column)).alias("x"))

    def take(found: Column, field: Column) -> Column:
        named = F.filter("x", lambda c: F.array_contains(c["names"], field) & ~F.array_contains(found, c["col"]))
        return F.array_append(found, F.coalesce(F.get(named, F.lit(0))["col"], F.lit(-1)))

    wide = _with(wide, named=F.aggregate(F.array(*map(F.lit, FIELDS)), F.array().cast("array<int>"), take))
    price, brand, code, described = (F.col("named")[i] for i in range(len(FIELDS)))
    wide = _with(wide, most=_best(F.col("named"), lambda c: c["numeric"]))
    guessed = (price < 0) & (F.col("rows") > 0) & (F.col("most.worth") / F.col("rows") > NUMERIC_SHARE)
    of_guess = F.get(F.filter("x", lambda c: c["col"] == F.col("most.col")), F.lit(0))["label_numeric"]
    wide = _with(wide, at=F.when(guessed, F.col("most.col")).when(price >= 0, price), again=guessed & (of_guess == 1))
    none = F.array().cast("array<int>")
    # with the first article back among the data, by figures alone
    anew = _best(none, lambda c: c["numeric"] + c["label_numeric"])["col"]
    wide = _with(wide, precio=F.when(F.col("again"), anew).otherwise(F.col("at")))
    used = F.array(F.coalesce("precio", F.lit(-1)))
    longest = F.when(F.col("rows") > 0, _best(F.concat(used, "named"), lambda c: c["length"])["col"])
    longest_anew = _best(used, lambda c: c["length"] + F.length(c["label"]))["col"]
    real = lambda c: F.when(~F.col("again") & (c >= 0), c)
    wide = _with(wide, first=F.col("header") + F.when(F.col("again"), 0).otherwise(1), marca=real(brand), codigo=real(code), descripcion=F.when(F.col("again"), longest_anew).when(described >= 0, described).otherwise(longest))
    return wide.select(*TABLE, "first", "precio", "marca", "codigo", "descripcion")


def without_price(cells: DataFrame) -> DataFrame:
    """source_id, tab_no, labels: tables in which no column is the price, with what their header says, to be told to a person."""
    none = columns_of(cells).filter("precio is null").select(*TABLE)
    row = cells.join(none, TABLE).join(headers(cells), TABLE).filter("row_no = header")
    return row.groupBy(*TABLE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda c: c["value"]), ", ").alias("labels"))


def table_lines(cells: DataFrame) -> DataFrame:
    """source_id, tab_no, line_no, code, description, brand, price (texts; empty where there is none) and line of the rows that name a product.

    A table without a price column has none: :func:`without_price` tells which."""
    rows = with_facts(cells, columns_of(cells).filter("precio is not null")).filter(F.col("row_no") >= F.col("first"))
    cell = lambda f: F.coalesce(F.max(F.when(F.col("col") == F.col(f), F.col("value"))), F.lit(""))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda c: c["value"]), " · ")
    out = rows.groupBy(*TABLE, "chunk", (F.col("row_no") - F.col("first")).alias("line_no")).agg(
        F.upper(cell("codigo")).alias("code"), cell("descripcion").alias("description"), cell("marca").alias("brand"), F.trim(F.replace(cell("precio"), F.lit("$"), F.lit(""))).alias("price"), line.alias("line")
    )
    return out.filter("code <> '' or description <> ''").drop("chunk")


# --- a tracking book


#: What a tab's columns say of its role, in order: a tab with a supplier column is of the first role of which a column holds a part.
ROLES = (("messages", ("mensaje",)), ("lists", ("envia", "lista")), ("manual", ("chequeado",)))
#: Fields of a book's rows and what their column holds.
PARTS = {"supplier": ("proveedor",), "message": ("mensaje",), "checked": ("chequeado",), "updated": ("actualiz", "fecha", "modific")}


def book_rows(cells: DataFrame) -> DataFrame:
    """source_id, tab_no, tab, role, seq, supplier, message, checked, updated of all tabs of books, in one plan.

    Tabs have unlike columns; each cell goes to the field that its column's label names, so tabs of one role stand under each other.
    Of a book's tabs for messages the first counts. Tabs without a supplier or a role, and rows without a supplier, give none."""
    plain = folded(F.col("value"))
    holds = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(plain, p))
    labels = cells.filter("row_no = 0")
    # a field's column: the first part that any label holds, then the leftmost
    place = lambda parts: F.min(F.coalesce(*(F.when(F.contains(plain, F.lit(p)), F.struct(F.lit(i).alias("part"), F.col("col"))) for i, p in enumerate(parts))))["col"]
    role = F.coalesce(*(F.when(F.max(holds(parts).cast("int")) == 1, F.lit(r)) for r, parts in ROLES))
    tabs = labels.groupBy(*TABLE).agg(role.alias("role"), *(place(parts).alias(f"at_{f}") for f, parts in PARTS.items())).filter("role is not null and at_supplier is not null")
    first = tabs.filter("role = 'messages'").groupBy("source_id").agg(F.min("tab_no").alias("spoken"))
    tabs = tabs.join(first, "source_id", "left").filter("role <> 'messages' or tab_no = spoken").drop("spoken")
    field = lambda f: F.coalesce(F.max(F.when(F.col("col") == F.col(f"at_{f}"), F.col("value"))), F.lit("")).alias(f)
    rows = with_facts(cells.filter("row_no > 0"), tabs).groupBy(*TABLE, "chunk", "tab", "role", F.col("row_no").alias("seq")).agg(*map(field, PARTS), F.max(F.col("at_checked").isNotNull()).alias("checks"))
    return rows.filter("supplier <> ''").drop("chunk")


def without_messages(cells: DataFrame) -> DataFrame:
    """source_id of books in which no tab holds suppliers and messages, to be told to a person."""
    rows = cells.filter("row_no = 0").withColumn("plain", folded(F.col("value")))
    has = lambda part: F.max(F.contains(F.col("plain"), F.lit(part)).cast("int"))
    good = rows.groupBy(*TABLE).agg((has("proveedor") * has("mensaje")).alias("good"))
    return good.groupBy("source_id").agg(F.max("good").alias("good")).filter("good = 0").select("source_id")
