"""Importance resampling towards a target: documents whose words and word pairs are more of the target's than of the corpus's.

Features are hashed into a fixed number of buckets. A first pass counts the buckets of the corpus and of the target, each task
summing its own batches; a bucket's gain is the logarithm of how much more frequent it is in the target. A second pass gives each
document the mean gain of its features, adds noise that depends on the id alone (Gumbel's, so the highest scores are a draw without
replacement by weight), and ranks.

Both passes work on Arrow arrays: texts are lower-cased and split by kernels, words are encoded as a dictionary, indices shifted
by one make word pairs, distinct pairs are found by encoding these codes again, and only distinct words and pairs are hashed.
Documents stay where they are: a pass shuffles one row for each bucket and task. The ranking sorts narrow rows by ranges; ranks are
places within a range plus the sizes of those before, so no task sees all rows.

Defined cases: a null text has no words, weight 0 and no rank; a null id is hashed as an empty one and comes after the others of
its score; rows of equal score and id are each ranked, in any order; an empty table gives no rows, an empty target gains below or at
0; other columns are ignored. Memory: a task holds the words of ``AT_ONCE`` bytes of texts (one text, if that is longer).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.llm.bytesops import chunks, column_bytes
from pricelode.llm.storage import picked, written

BUCKETS = 10_000
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN_WORDS = 20
SHARE = 25
SEED = 7
#: Bytes of texts that are worked on together.
AT_ONCE = 4 << 20
#: monotonically_increasing_id is a partition's number above so many bits, and a row's below.
ROW_BITS = 33


def features(texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Words of each text; and for words and for word pairs: each one's text, its distinct value, and the values' buckets."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    flat, text = pc.list_flatten(lists), pc.list_parent_indices(lists)
    solid = pc.greater(pc.binary_length(flat), 0)
    flat, text = flat.filter(solid), text.filter(solid).to_numpy().astype(np.int64)
    coded = flat.dictionary_encode()
    word = coded.indices.to_numpy().astype(np.int64)
    spelled = coded.dictionary.cast(pa.binary()).to_pylist()
    crc = [zlib.crc32(w) for w in spelled]
    together = text[:-1] == text[1:]
    pairs = pa.array((word[:-1] * len(spelled) + word[1:])[together]).dictionary_encode()
    left, right = np.divmod(pairs.dictionary.to_numpy(), max(len(spelled), 1))
    after = [b" " + w for w in spelled]
    paired = [zlib.crc32(after[b], crc[a]) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    bucket = lambda values: np.array(values, np.int64) % BUCKETS
    n_words = np.bincount(text, minlength=len(texts))
    return n_words, [(text, word, bucket(crc)), (text[:-1][together], pairs.indices.to_numpy().astype(np.int64), bucket(paired))]


def pieces(column: pa.Array) -> Iterator[pa.Array]:
    """A column of texts in runs of ``AT_ONCE`` bytes; nulls are empty."""
    filled = column.fill_null("")
    for i, j in chunks(column_bytes(filled)[1], AT_ONCE):
        yield filled.slice(i, j - i)


def bucket_counts(frame: DataFrame) -> DataFrame:
    """(bucket, n): how many features of all texts (column text) are in each bucket that has any."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for texts in pieces(batch.column(0)):
                for _, value, bucket in features(texts)[1]:
                    np.add.at(total, bucket, np.bincount(value, minlength=len(bucket)))
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(total[have])], ["bucket", "n"])

    return picked(frame, "text").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Each bucket's gain; what comes to the driver is a number for each bucket."""
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for frame, out in ((docs, s), (target, t)):
        for r in bucket_counts(frame).collect():
            out[r["bucket"]] = r["n"]
    all_s, all_t = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + BUCKETS) / ((a + 1) * (all_t + BUCKETS)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def noise(doc_id: object) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(gain)
    frame = picked(docs, "doc_id", "text")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(1)):
                ids = batch.column(0).slice(at, len(texts))
                at += len(texts)
                n_words, families = features(texts)
                n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for text, value, bucket in families:
                    upto = np.concatenate(([0], np.cumsum(sent.value[bucket][value]))).astype(np.int64)
                    edges = np.searchsorted(text, np.arange(len(texts) + 1))
                    n += np.diff(edges)
                    total += upto[edges[1:]] - upto[edges[:-1]]
                weight = total // np.maximum(n, 1)
                score = weight + np.array([noise(i) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (n_words, n, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    kind = frame.schema["doc_id"].dataType.simpleString()
    return frame.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def ranked(spark: SparkSession, scored: DataFrame) -> DataFrame:
    """``scored`` with the rank of the drawn rows: the best ``SHARE`` hundredths of the texts with ``MIN_WORDS`` words."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    able = F.col("n_words") >= MIN_WORDS
    # equal keys are dealt over several ranges by the last one
    order = ["later", "down", F.col("doc_id").asc_nulls_last(), "salt"]
    salted = scored.withColumn("salt", F.rand(SEED))
    dealt = salted.withColumns({"later": ~able, "down": -F.col("score")}).repartitionByRange(n, *order)
    placed = written(dealt.sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()).drop("salt", "later", "down"), "ranked")
    part = F.shiftright("place", ROW_BITS)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(able).alias("able")).collect()  # a row for each range
    drawn, before = SHARE * sum(r["able"] for r in sizes) // 100, {}
    upto = 0
    for r in sorted(sizes):
        before[r["part"]] = upto
        upto += r["n"]
    starts = F.array(*(F.lit(before.get(i, 0)).cast("long") for i in range(max(before, default=0) + 1)))
    rank = F.get(starts, part.cast("int")) + F.col("place").bitwiseAND((1 << ROW_BITS) - 1) + 1
    return placed.withColumn("rank", F.when(able & (rank <= drawn), rank))


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score and rank."""
    scored = written(weighed(docs, gains(docs, target)), "weighed")
    return ranked(docs.sparkSession, scored).select("doc_id", "n_features", "weight", "score", "rank")
