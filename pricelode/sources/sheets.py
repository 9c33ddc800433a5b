"""Tracking sheets (S3, S4, J22): local CSV files through Spark, remote ones through a given opener."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.constants import CHECKED_WORDS
from pricelode.functions.text import normalize
from pricelode.operators.alike import name_pairs
from pricelode.sources.office import sheet_headers


def sheet_rows(raw: DataFrame, seq: str = "seq") -> DataFrame:
    """S3: supplier, checked (null without such a column), message, updated; rows without a supplier go."""
    at = sheet_headers([c for c in raw.columns if c != seq])
    text = lambda f: F.trim(F.coalesce(F.col(f"`{at[f]}`"), F.lit(""))) if at[f] else F.lit("")
    checked = F.upper(text("checked")).isin(*CHECKED_WORDS) if at["checked"] else F.lit(None).cast("boolean")
    return raw.select(seq, text("supplier").alias("supplier"), checked.alias("checked"), text("message").alias("message"), text("updated").alias("updated")).filter("supplier <> ''")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.withColumnsRenamed({c: c.lstrip("﻿") for c in raw.columns})
    return sheet_rows(raw.withColumn("seq", F.monotonically_increasing_id()))


def sheet_state() -> Column:
    """What a row says: pending, unchanged or message."""
    return F.when(~F.coalesce("checked", F.lit(True)), "pending").when(F.col("message") == "", "unchanged").otherwise("message")


def csv_url(link: str) -> str:
    """The CSV export of a shared sheet's link, its tab kept."""
    m = re.search(r"/spreadsheets/d/([\w-]+)", link)
    if not m:
        raise ValueError(f"not a link to a shared sheet: {link}")
    gid = re.search(r"[#?&]gid=(\d+)", link)
    return f"https://docs.google.com/spreadsheets/d/{m[1]}/export?format=csv" + (f"&gid={gid[1]}" if gid else "")


def _shared(content: bytes) -> bytes:
    if content.lstrip()[:1] == b"<":
        raise PermissionError("the sheet isn't shared with everyone who has the link")
    return content


def download(link: str, opener: Callable[[str], bytes]) -> bytes:
    """The sheet as CSV, through ``opener``; a page instead of a table means that it isn't shared."""
    return _shared(opener(csv_url(link)))


def book_link(link: str) -> str:
    """The export of a shared sheet's whole book, all tabs in one file."""
    return csv_url(link).split("/export?")[0] + "/export?format=xlsx"


def remote_books(links: DataFrame, opener: Callable[[str], bytes]) -> DataFrame:
    """source_id, name, content of the books behind links (source_id, link), each fetched in a task through ``opener``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                content = _shared(opener(book_link(r["link"])))
                yield pa.RecordBatch.from_arrays([pa.array([r["source_id"]], pa.int64()), pa.array(["book.xlsx"]), pa.array([content], pa.binary())], ["source_id", "name", "content"])

    return links.select("source_id", "link").mapInArrow(task, "source_id long, name string, content binary")


def book_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a book's rows (:func:`pricelode.sources.cells.book_rows`) its messages as :func:`sheet_rows` gives them,
    the suppliers whose lists are expected, and those that a person checks by hand."""
    checked = F.upper("checked").isin(*CHECKED_WORDS)
    of = lambda role: rows.filter(F.col("role") == role)
    sheet = of("messages").select("source_id", "seq", "supplier", F.when(F.col("checks"), checked).alias("checked"), "message", "updated")
    return sheet, of("lists").select("source_id", "supplier"), of("manual").select("source_id", "supplier", checked.alias("checked"))


def missing_lists(expected: DataFrame, loaded: DataFrame, cut: float = 90) -> DataFrame:
    """Expected suppliers (supplier) without a loaded list (supplier)."""
    e = expected.select("supplier", normalize("supplier").alias("_e"))
    pairs = name_pairs(e.select(F.col("_e").alias("name")), loaded.select(normalize("supplier").alias("name")), "set", cut)
    return e.join(pairs, e["_e"] == pairs["l"], "left_anti").select("supplier").distinct()
