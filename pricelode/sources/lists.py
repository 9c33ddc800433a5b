"""Any list file to articles (S12): Word, tables, and text lists; files without articles become messages.

PDF pages and photos need a reader that turns a file into lines (``pdf``, ``photo``); none is built in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.functions.phrases import PRICE_IN_TEXT
from pricelode.sources import cells, office, pricelists
from pricelode.storage import kept

Reader = Callable[[bytes], list[str]]


def file_lines(files: DataFrame, pdf: Reader | None = None, photo: Reader | None = None) -> DataFrame:
    """source_id, line_no, line of Word documents, PDF files, photos and text files; an upload is read inside one task."""

    def lines(name: str, content: bytes) -> list[str]:
        kind = office.kind_of(name, content)
        if kind == "docx":
            text, _, pictures = office.docx_parts(content)
            if sum(len("".join(t.split())) for t in text) < 20 and pictures and photo:
                return [x for p in pictures for x in photo(p)]
            return text
        if kind in ("pdf", "image"):
            reader = pdf if kind == "pdf" else photo
            if reader is None:
                raise RuntimeError(f"reading {name} needs a reader of {kind} files")
            return reader(content)
        return content.decode("utf-8-sig", errors="replace").splitlines() if kind == "text" else []

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r["source_id"], n, x) for r in batch.to_pylist() for n, x in enumerate(lines(r["name"], r["content"]))]
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["source_id", "line_no", "line"])

    return files.select("source_id", "name", "content").mapInArrow(task, "source_id long, line_no long, line string")


def word_cells(files: DataFrame) -> DataFrame:
    """Cells of the tables in Word documents, each table for itself; written once."""

    def tables(name: str, content: bytes) -> list[tuple[str, list[list[str]]]]:
        return [("", t) for t in office.docx_parts(content)[1]] if office.is_docx(content) else []

    return kept(cells.file_cells(files, tables), "cells")


def read_lists(files: DataFrame, names: DataFrame, pdf: Reader | None = None, photo: Reader | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles, unread lines, and texts (source_id, text) of files that have prices but no articles.

    files: source_id, name, content; names: key, canonical of known brands."""
    lower = F.lower("name")
    table = lower.rlike(r"\.(xlsx|xls|csv)$")
    lines = file_lines(files.filter(~table), pdf, photo)
    sheet = pricelists.first_sheets(files.filter(table).select("source_id", "name", "content"))
    tables = pricelists.cell_articles(sheet, names).unionByName(pricelists.cell_articles(word_cells(files.filter(~table)), names))
    texts, unread = pricelists.text_articles(lines.join(tables.select("source_id").distinct(), "source_id", "left_anti"), names)
    articles = tables.unionByName(texts)
    whole = lines.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    messages = whole.join(articles.select("source_id").distinct(), "source_id", "left_anti").filter(F.col("text").rlike(PRICE_IN_TEXT))
    # a sheet whose price column can't be told is for a person to see
    unread = unread.unionByName(cells.without_price(sheet).select("source_id", F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("sin columna de precio: "), "labels").alias("line")))
    return articles, unread.join(messages.select("source_id"), "source_id", "left_anti"), messages
