"""Names that are alike, found by what they must have in common: all pairs above a score, without comparing all names.

A score of ``cut`` leaves a pair little room for differences. Two indexes find every pair that can reach it:

* **Words.** Where one name is nearly part of the other, the words that it has alone are short. Its rarest words that are together longer
  than that can't all be missing from the other: they are looked up among the other side's words.
* **Letters.** Else letters were put in or left out, ``room`` of them at most, which follows from the cut and both lengths. The alphabet is cut
  into blocks, so many that one block at least keeps all of its letters but one (two, in long names). The counts of a block's letters, and the
  counts that are one letter off, are looked up among the other side's names of a fitting length. No order of words and no position matters,
  so misspelt words that sort elsewhere are found too.

What meets is held against a bound where it is joined, before any score is taken: the words that one has alone, or the letters that the counts differ
in. Names are never collected; a key that very many names have (a frequent letter count) is a join key like any other, which adaptive
execution splits where it is skewed.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.functions.fuzzy import token_set_ratio, token_sort_ratio

SCORERS = {"set": token_set_ratio, "sort": token_sort_ratio}

#: Letters from the most frequent on, so that blocks come out even; whatever else is in a name counts as one more.
LETTERS = "eaosrnidlcumptbgvyqhfzjxkw0123456789"
OTHER = len(LETTERS)
#: A whole number for each letter; a block's key is the sum over its letters, so one letter more or less is an addition.
WEIGHTS = np.array([int(hashlib.sha256(f"letter {i}".encode()).hexdigest()[:10], 16) for i in range(OTHER + 1)], np.int64)
PLACE = {x: i for i, x in enumerate(LETTERS)}
#: Lengths that share a scheme of blocks.
BAND = 3
#: From this room on, a block may be two letters off.
WIDE = 10
LONGEST = 300
#: Marks for a letter, letters in a whole number.
MOST, PER_LONG = 7, 9
MARKS = [f"marks{i}" for i in range(-(-(OTHER + 1) // PER_LONG))]
#: Rows of keys in a batch.
AT_ONCE = 50_000


def room(total: Column | int, cut: float) -> Column | int:
    """Letters that may be put in or left out between two names of ``total`` letters together; as odd or even as the total."""
    if isinstance(total, int):
        return total - 2 * math.ceil(cut * total / 200 - 1e-9)
    return total - 2 * F.ceil(F.lit(cut) * total / 200 - 1e-9)


def schemes(cut: float) -> list[tuple[int, int]]:
    """(blocks, letters that one of them may be off) for the names of each band of lengths; the last holds for all longer ones, too."""
    out = []
    for band in range(LONGEST // BAND + 1):
        longest = band * BAND + BAND - 1
        other = math.floor(longest * (200 - cut) / cut + 1e-9)
        most = max(room(longest + other, cut), room(longest + other - 1, cut), 0)
        off = 0 if most == 0 else 1 if most < WIDE else 2
        out.append((min(most // (off + 1) + 1, OTHER + 1), off))
    return out


def block_of(letter: int, blocks: int) -> int:
    """Letters are dealt to blocks to and fro."""
    lap, place = divmod(letter, blocks)
    return place if lap % 2 == 0 else blocks - 1 - place


def _words(names: DataFrame, scorer: str) -> DataFrame:
    """name, words and size of each distinct name, as the scorer reads it."""
    words = F.filter(F.split("name", r"\s+"), lambda w: w != "")
    read = F.array_distinct(words) if scorer == "set" else words
    return names.select("name").distinct().filter("name <> ''").withColumn("words", read).withColumn("size", F.length(F.array_join("words", " ")))


def _bags(texts: list[str]) -> np.ndarray:
    """The counts of each text's letters, blanks left out."""
    out = np.zeros((len(texts), OTHER + 1), np.int64)
    for i, text in enumerate(texts):
        for x, n in Counter(text).items():
            out[i, PLACE.get(x, OTHER)] += n
    return out


def _marks(bag: np.ndarray) -> list[pa.Array]:
    """Counts as marks, one for each time that a letter comes, ``MOST`` at most: where two names' marks differ, their counts do."""
    unary = (1 << np.minimum(bag, MOST)) - 1
    return [pa.array((unary[:, i : i + PER_LONG] << (MOST * np.arange(unary[:, i : i + PER_LONG].shape[1]))).sum(axis=1)) for i in range(0, OTHER + 1, PER_LONG)]


def _keyed(names: DataFrame, cut: float, near: bool) -> DataFrame:
    """Rows (name, size, marks, band, block, key) under which a name's counts of letters are looked up.

    ``near`` sides stand under their own band, with the counts that are one letter off; the other side stands under every band of a
    length that fits, as it is, or one letter off as well where two may differ."""
    plan = schemes(cut)
    last = len(plan) - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).to_numpy().astype(np.int64)
            bag = _bags(batch.column(2).to_pylist())
            marks = _marks(bag)
            low, high = size, size
            if not near:
                low, high = np.ceil(size * cut / (200 - cut) - 1e-9).astype(np.int64), np.floor(size * (200 - cut) / cut + 1e-9).astype(np.int64)
            low, high = np.minimum(low // BAND, last), np.minimum(high // BAND, last)
            for band in range(int(low.min(initial=last + 1)), int(high.max(initial=-1)) + 1):
                which = np.flatnonzero((low <= band) & (band <= high))
                blocks, off = plan[band]
                place = np.array([block_of(i, blocks) for i in range(OTHER + 1)])
                own = (bag[which] * WEIGHTS) @ (place[:, None] == np.arange(blocks))
                parts = [(np.repeat(which, blocks), np.tile(np.arange(blocks), len(which)), own.ravel())]
                if off > (0 if near else 1):
                    moved = own[:, place]
                    more, less = np.ones(moved.shape, bool), bag[which] > 0
                    for have, sign in ((more, 1), (less, -1)):
                        i, letter = np.nonzero(have)
                        parts.append((which[i], place[letter], (moved + sign * WEIGHTS)[i, letter]))
                row, block, key = (np.concatenate(x) for x in zip(*parts, strict=True))
                for at in range(0, len(row), AT_ONCE):
                    part = pa.array(row[at : at + AT_ONCE])
                    arrays = [batch.column(0).take(part), batch.column(1).take(part), *(bits.take(part) for bits in marks), pa.array(np.full(len(part), band, np.int32)), pa.array(block[at : at + AT_ONCE].astype(np.int32)), pa.array(key[at : at + AT_ONCE])]
                    yield pa.RecordBatch.from_arrays(arrays, ["name", "size", *MARKS, "band", "block", "key"])

    return names.select("name", "size", F.array_join("words", "").alias("text")).mapInArrow(rows, f"name string, size int, {', '.join(f'{m} long' for m in MARKS)}, band int, block int, key long")


def marked(names: DataFrame, scorer: str) -> DataFrame:
    """name, size, repeats (a word comes twice) and the marks of each distinct name's letters: what bounds a score by columns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *_marks(_bags(batch.column(3).to_pylist()))], ["name", "size", "repeats", *MARKS])

    repeats = F.size(F.array_distinct("words")) < F.size("words")
    marks = ", ".join(f"{m} long" for m in MARKS)
    return _words(names, scorer).select("name", "size", repeats.alias("repeats"), F.array_join("words", "").alias("text")).mapInArrow(rows, f"name string, size int, repeats boolean, {marks}")


def letters_apart(left: str, right: str) -> Column:
    """How many letters two names differ in at least, by the marks in columns of these prefixes."""
    return sum((F.bit_count(F.col(f"{left}{m}").bitwiseXOR(F.col(f"{right}{m}"))) for m in MARKS), F.lit(0))


def _rare_words(side: DataFrame, count: DataFrame, spare: float) -> DataFrame:
    """(name, word, words, size): each name's rarest words, until they are longer than what it may have alone."""
    rows = side.select("name", "words", "size", F.explode("words").alias("word")).join(count, "word")
    before = Window.partitionBy("name").orderBy("n", "word").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("spent", F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))).filter(F.col("spent") <= F.col("size") * spare + 1e-9).select("name", "word", "words", "size")


def _alone(a: Column, b: Column) -> Column:
    """Letters of the words that only a has, with a blank for each."""
    return F.aggregate(F.array_except(a, b), F.lit(0), lambda n, w: n + F.length(w) + 1)


def met_by_letters(left: DataFrame, right: DataFrame, scorer: str, cut: float) -> DataFrame:
    """(l, r) of the names whose counts of letters leave room for the score: one row for each block that brings them together."""
    a, b = _words(left, scorer), _words(right, scorer)
    named = lambda df, side: df.select(F.col("name").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("size", *MARKS)), "band", "block", "key")
    both, other = named(_keyed(a, cut, True), "l"), named(_keyed(b, cut, False), "r")
    return both.join(other, ["band", "block", "key"]).filter(letters_apart("l_", "r_") <= room(F.col("l_size") + F.col("r_size"), cut)).select("l", "r")


def met_by_words(left: DataFrame, right: DataFrame, cut: float) -> DataFrame:
    """(l, r) of the names of which one has the other's rarest words, and of which one has little alone: one row for each such word."""
    spare = 2 * (100 - cut) / (200 - cut)  # of a name, in words that the other lacks
    a, b = _words(left, "set"), _words(right, "set")
    every = [x.select("name", F.explode("words").alias("word"), "words", "size") for x in (a, b)]
    count = every[0].unionByName(every[1]).groupBy("word").agg(F.count("*").alias("n"))
    ways = [(_rare_words(a, count, spare), every[1]), (every[0], _rare_words(b, count, spare))]
    named = lambda df, side: df.select("word", *(F.col(c).alias(f"{side}_{c}") for c in ("name", "words", "size")))
    pairs = [named(x, "l").join(named(y, "r"), "word") for x, y in ways]
    little = lambda x, y: _alone(F.col(f"{x}_words"), F.col(f"{y}_words")) <= F.col(f"{x}_size") * spare + 1e-9
    return pairs[0].unionByName(pairs[1]).filter(little("l", "r") | little("r", "l")).select(F.col("l_name").alias("l"), F.col("r_name").alias("r"))


def candidates(left: DataFrame, right: DataFrame, scorer: str, cut: float) -> DataFrame:
    """(l, r): the pairs that may score ``cut``, once each. Every pair that does is among them."""
    pairs = met_by_letters(left, right, scorer, cut)
    if scorer == "set":
        pairs = pairs.unionByName(met_by_words(left, right, cut))
    return pairs.distinct()


def name_pairs(left: DataFrame, right: DataFrame, scorer: str, cut: float) -> DataFrame:
    """(l, r, score) of the distinct names l of ``left`` and r of ``right`` (column name) that score ``cut`` or more."""
    scored = candidates(left, right, scorer, cut).withColumn("score", SCORERS[scorer](F.col("l"), F.col("r")))
    return scored.filter(F.col("score") >= cut)
