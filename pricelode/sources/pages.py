"""Pages as rows: the columns of a page from the places of its words, and the lines of a photo from the places of its boxes.

Words and boxes come from a reader of the caller's, one row each. All pages are worked on at once: a page is a group, and none is more
than what stands on one sheet.

Defined cases: a page without words has no row; a page with one column has a null cut; boxes of one height and place are in order of their texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What an article's code looks like at the start of a column; the left part of a page, as a share of its width.
CODE = r"^(?:[A-Za-z]{1,4}-\d{3,6}|\d{4,7})$"
LEFT = 0.3
#: Words within so much of a height are in one row; codes within so much of a place are in one column, which starts that much before them.
SAME_ROW, SAME_PLACE, MARGIN = 2, 3, 1.5
LEAST_LEFT, LEAST_RIGHT, RIGHT_SHARE = 3, 5, 0.3
#: Boxes are on a line while they are off its first box by less than this share of the higher one.
SAME_LINE = 0.6


def column_cuts(words: DataFrame) -> DataFrame:
    """(page, cut) of words (page, width, text, x0, x1, top): where a second column of articles starts, null where there is none.

    The codes of a second column have words to their right in their row, and most of them start at one place."""
    row = Window.partitionBy("page").orderBy("top").rangeBetween(-SAME_ROW, SAME_ROW)
    codes = words.withColumn("goes_on", F.max("x0").over(row) > F.col("x1")).filter(F.col("text").rlike(CODE)).withColumn("left", F.col("x0") < LEFT * F.col("width"))
    right = codes.filter("not left and goes_on")
    place = right.groupBy("page", F.rint("x0").alias("place")).agg(F.count("*").alias("n")).groupBy("page").agg(F.max_by("place", F.struct("n", -F.col("place"))).alias("place"))
    near = F.abs(F.col("x0") - F.col("place")) <= SAME_PLACE
    aligned = right.join(place, "page").filter(near).groupBy("page").agg(F.min("x0").alias("start"), F.count("*").alias("n"))
    whole = words.select("page").distinct().join(codes.groupBy("page").agg(F.count_if("left").alias("lefts")), "page", "left").join(aligned, "page", "left")
    enough = (F.col("lefts") >= LEAST_LEFT) & (F.col("n") >= F.greatest(F.lit(float(LEAST_RIGHT)), RIGHT_SHARE * F.col("lefts")))
    return whole.select("page", F.when(enough, F.col("start") - MARGIN).alias("cut"))


def column_lines(words: DataFrame) -> DataFrame:
    """(page, side, line, text): the lines of each page's left column, then of its right one; words of a height are a line."""
    sided = words.join(column_cuts(words), "page").withColumn("side", F.when(F.col("x0") >= F.col("cut"), 1).otherwise(0))
    # a height near the one above is of its line
    w = Window.partitionBy("page", "side").orderBy("top", "x0", "text")
    starts = F.coalesce(F.col("top") - F.lag("top").over(w) > SAME_ROW, F.lit(True)).cast("int")
    lines = sided.withColumn("starts", starts).withColumn("line", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    return lines.groupBy("page", "side", "line").agg(text.alias("text"))


def box_lines(boxes: DataFrame) -> DataFrame:
    """(page, line, text): boxes (page, y, height, x, text) in reading order.

    A line ends where a box is too far from the line's first one, so where it ends hangs on where it began: a fold over the page's boxes in order."""
    box = F.struct("y", "x", "height", "text")
    pages = boxes.groupBy("page").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    none = F.expr("named_struct('y', cast(null as double), 'height', 0.0d, 'line', -1, 'lines', cast(array() as array<int>))")

    def step(s, b):
        same = F.coalesce(F.abs(b["y"] - s["y"]) <= SAME_LINE * F.greatest(b["height"], s["height"]), F.lit(False))
        line = F.when(same, s["line"]).otherwise(s["line"] + 1)
        return F.struct(F.when(same, s["y"]).otherwise(b["y"]).alias("y"), F.when(same, s["height"]).otherwise(b["height"]).alias("height"), line.alias("line"), F.array_append(s["lines"], line).alias("lines"))

    lines = pages.withColumn("lines", F.aggregate("boxes", none, step, lambda s: s["lines"])).select("page", F.inline(F.arrays_zip("boxes", "lines")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("boxes.x", "boxes.text"))), lambda b: b["text"]), "  ")
    return lines.groupBy("page", F.col("lines").alias("line")).agg(zeros(text).alias("text"))


def zeros(text):
    """Letters O in prices are zeros."""
    return F.regexp_replace(text, r"(?<=\$\s{0,4}[\dOo.,]{0,20})[Oo]", "0")


def photo_lines(photos: DataFrame, reader: Callable[[bytes], list[tuple[list[tuple[float, float]], str]]] | None) -> DataFrame:
    """The lines of photos (page, content) by a given reader of boxes (corners and text); none is built in."""
    if reader is None:
        raise RuntimeError("reading photos and scans needs an OCR callable")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page, content in zip(frame["page"], frame["content"], strict=True):
                for corners, text in reader(bytes(content)):
                    xs, ys = zip(*corners, strict=True)
                    rows.append((page, sum(ys) / len(ys), float(max(ys) - min(ys)), float(min(xs)), text))
            yield pd.DataFrame(rows, columns=["page", "y", "height", "x", "text"])

    kind = photos.schema["page"].dataType.simpleString()
    return box_lines(photos.select("page", "content").mapInPandas(read, f"page {kind}, y double, height double, x double, text string"))
