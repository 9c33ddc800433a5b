"""Messages from a drop folder as a stream (2.12): the same cycle, batch by batch.

A file that comes twice is no new price. :func:`run_batches` keeps what was processed as a table (fingerprints) that each batch is joined with:
a copy is known for ever, however late it comes. Where copies come within a known time, :func:`first_copies` keeps the fingerprints as the
stream's own state, which forgets them after it, so a batch costs what is in it. :func:`answered` joins quotes with the decisions on them as two streams. Event-time counts of the decision
log show watermarks for those who want a live dashboard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricelode.functions.text import fingerprint
from pricelode.operators import memory


def dropped_messages(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of text files: origin (path), text, huella."""
    raw = spark.readStream.format("text").option("wholetext", True).load(folder)
    return raw.select(F.col("_metadata.file_path").alias("origin"), F.col("value").alias("text"), fingerprint(F.col("value")).alias("huella"))


def run_batches(messages: DataFrame, processed_path: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``handle`` with each batch's new messages, then records their fingerprints."""

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        done = spark.read.schema("huella string, batch long").option("recursiveFileLookup", True).parquet(processed_path)
        # a batch that is run again after a failure must see its own messages as new
        fresh = memory.not_processed(df.dropDuplicates(["huella"]), done.filter(F.col("batch") != batch_id), ["huella"]).persist()
        handle(fresh, batch_id)
        fresh.select("huella", F.lit(batch_id).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{processed_path}/batch={batch_id}")
        fresh.unpersist()

    messages.sparkSession.createDataFrame([], "huella string, batch long").write.mode("append").parquet(processed_path)
    return messages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def first_copies(messages: DataFrame, at: str = "at", within: str = "30 days") -> DataFrame:
    """The messages (huella, and the time in column ``at``) of which no copy came before within that time; state is dropped once no copy can come any more."""
    return messages.withWatermark(at, within).dropDuplicatesWithinWatermark(["huella"])


def answered(quotes: DataFrame, decisions: DataFrame, within: str = "7 days", late: str = "1 day") -> DataFrame:
    """Quotes (huella, at, and more) with the decisions (huella, decided_at, action) that were made on them ``within`` a time; both may be
    streams, each of which may be ``late``. A quote waits for its decisions as state until none can come any more."""
    q = quotes.withWatermark("at", late)
    d = decisions.withWatermark("decided_at", late).withColumnRenamed("huella", "_huella")
    in_time = (F.col("decided_at") >= F.col("at")) & (F.col("decided_at") <= F.col("at") + F.expr(f"interval {within}"))
    return q.join(d, (F.col("huella") == F.col("_huella")) & in_time).drop("_huella")


def decisions_per_window(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Decisions by kind and time window, late ones up to ``late``; works on streams and tables."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
