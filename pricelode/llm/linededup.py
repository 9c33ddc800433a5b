"""Line dedup by overlapping windows of three lines.

A window is three consecutive lines that have a character other than white space (lines are
compared as they stand, without trailing white space). A window's 128-bit hash is looked for
in the whole corpus; its first occurrence, by (doc_id, line), stays and every later one marks the lines
that it covers. Covered lines are merged into runs, blank lines between covered lines go
with them, and the runs are cut out of their texts.

Window rows are (hash, row, line); a first pass keeps the least of each hash with
map-side combining, so one very common passage costs each task one row. A second pass finds the
later occurrences by a join on the hash, which adaptive execution splits where a hash is hot.

Defined cases: a null text stays null; a text of fewer than three such lines has no window and
stays whole; of two equal windows in one text the first stays, and what a later one shares with it
goes; rows with one doc_id and one text are one document and get one result, each its own row;
documents without an id come last in the order; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.llm.bytesops import Spans, chunks, column_bytes, mix
from pricelode.llm.storage import aliased, picked, with_fields, written

WIDTH = 3
_blank = np.zeros(256, bool)
_blank[list(b" \t\r\x0b\x0c")] = True


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (without trailing white space), documents and numbers of the non-blank lines."""
    n = len(data)
    cut = data == 10
    starts = np.union1d(np.flatnonzero(cut) + 1, offsets[:-1])
    starts = starts[starts < n]
    ends = np.append(starts[1:], n)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(starts, offsets[doc])
    number = np.arange(len(starts)) - first
    solid = np.flatnonzero(~(_blank[data] | cut))  # the last solid byte before each end
    k = np.searchsorted(solid, ends) - 1
    last = np.where(k >= 0, solid[np.maximum(k, 0)], -1) if len(solid) else np.full(len(ends), -1)
    keep = last >= starts
    return starts[keep], last[keep] + 1, doc[keep], number[keep]


def windows_of(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes, document, first and last line number of every window."""
    starts, ends, doc, number = lines_of(data, offsets)
    if len(starts) < width:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    line = Spans(data).of(starts, ends)
    other = mix(line ^ (Spans(data[::-1]).of(len(data) - ends, len(data) - starts) * np.uint64(0xD6E8FEB86659FD93)))
    n = len(line) - width + 1
    a, b = line[:n].copy(), other[:n].copy()
    for k in range(1, width):
        a = mix(a * np.uint64(0x9E3779B97F4A7C15) + line[k : k + n])
        b = mix(b * np.uint64(0xC2B2AE3D27D4EB4F) + other[k : k + n])
    keep = doc[:n] == doc[width - 1 :]
    return a[keep], b[keep], doc[:n][keep], number[:n][keep], number[width - 1 :][keep]


def window_rows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per window: h1, h2, doc_id, tkey (tells texts of one id apart), first, last."""
    names = ["h1", "h2", "doc_id", "tkey", "first", "last"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            for i, j in chunks(offsets):
                a, b, doc, first, last = windows_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                row = pa.array(doc + i)
                lines = [pa.array(x.astype(np.int32)) for x in (first, last)]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), *lines], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    return rows.mapInArrow(task, f"h1 long, h2 long, doc_id {kind}, tkey long, first int, last int")


def later_windows(windows: DataFrame) -> DataFrame:
    """The windows that aren't the first of their hash: doc_id, tkey, first, last."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey", F.col("first").alias("at"))
    firsts = windows.groupBy("h1", "h2").agg(F.min(place).alias("keep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    same = F.col("keep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keep.tkey") == F.col("tkey")) & (F.col("keep.at") == F.col("first"))
    return windows.join(firsts, ["h1", "h2"]).filter(~same).select("doc_id", "tkey", "first", "last")


def cut(text: str | None, spans: list[tuple[int, int]] | None) -> tuple[str | None, int]:
    """A text without the lines of the spans (and blank lines between them), and how many went."""
    if text is None or not spans:
        return text, 0
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, bool)
    for a, b in spans:
        gone[a : b + 1] = True
    i = 0
    while i < len(lines):  # blank lines between two covered lines
        if not gone[i] and not lines[i].strip(" \t\r\x0b\x0c"):
            j = i
            while j < len(lines) and not gone[j] and not lines[j].strip(" \t\r\x0b\x0c"):
                j += 1
            if i and gone[i - 1] and gone[j] and j < len(lines):
                gone[i:j] = True
            i = j
        else:
            i += 1
    return "\n".join(x for x, g in zip(lines, gone, strict=False) if not g), int(gone[:-1].sum())


def shortened(frame: DataFrame, doc_id: str, text: str, width: int = WIDTH) -> DataFrame:
    """``frame`` with the new text, and n_lines_removed; every row stays. Its own names must not be of these: n_lines_removed, _id, _tkey, _spans."""
    windows = written(window_rows(frame.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width), "line_windows")
    spans = later_windows(windows).groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("first", "last")).alias("_spans"))
    spans = spans.withColumnsRenamed({"doc_id": "_id", "tkey": "_tkey"})
    both = frame.join(spans.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col(doc_id)) & (F.col("_tkey") == F.xxhash64(text)), "left").drop("_id", "_tkey")
    at, names = frame.columns.index(text), frame.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = [], []
            for t, spans in zip(batch.column(at), batch.column(len(names)), strict=True):
                pairs = spans.as_py()
                new, gone = cut(t.as_py(), [(x["first"], x["last"]) for x in pairs]) if pairs else (t.as_py(), 0)
                texts.append(new)
                n.append(gone)
            columns = [pa.array(texts, batch.column(i).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], [*names, "n_lines_removed"])

    return both.mapInArrow(task, with_fields(frame, "n_lines_removed long"))


def deduped(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the new text, and n_lines_removed as the last column; every row stays."""
    frame, name = aliased(docs)
    return shortened(frame, name["doc_id"], name["text"], width).toDF(*docs.columns, "n_lines_removed")


def left(docs: DataFrame) -> DataFrame:
    """``docs`` with the new texts and their n_chars; documents of which no line is left are dropped.

    Columns of any names are carried through."""
    frame, name = aliased(docs)
    out = shortened(frame, name["doc_id"], text := name["text"])
    changed = F.col("n_lines_removed") > 0
    out = out.filter(~changed | F.col(text).rlike(r"[^ \t\n\r\x0b\x0c]"))
    if n := name.get("n_chars"):
        out = out.withColumn(n, F.when(changed, F.length(text).cast(frame.schema[n].dataType)).otherwise(F.col(n)))
    return out.select(*frame.columns).toDF(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_lines_removed, n_removed (code points, line ends included) and a digest of what is left."""
    slim = picked(docs, "doc_id", "text").select("doc_id", "text", F.length("text").alias("old_chars"), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("lines"))
    out = deduped(slim)
    left = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", F.when(F.col("old_chars").isNull(), 0).otherwise(F.col("lines")).cast("long").alias("n_lines"), "n_lines_removed",
        (F.coalesce("old_chars", F.lit(0)) - F.length(left)).cast("long").alias("n_removed"), F.sha2(left, 256).alias("kept_sha256"),
    )
