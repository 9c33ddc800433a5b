"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record hashes into one of ``n_slots`` virtual slots, for good. Bytes are summed
per slot, and a small map says which shard holds a slot. Rebalancing edits the map
(:func:`rebalance`, :func:`grow`) and raises its version; records are never hashed anew.

The map has one row per virtual slot, so its size is fixed by ``n_slots`` whatever
the data's size: that is what the driver sees and what is broadcast.

Defined cases: a null text has no bytes (crc32 of nothing, size ``overhead``); a null id
takes its slot from the text's checksum; repeated rows stand side by side in one shard;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.llm.storage import new_path, picked

N_SLOTS = 8192
OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """``shard[i]`` holds virtual slot i; ``version`` goes up by one with every edit."""

    version: int
    n_shards: int
    shard: tuple[int, ...]

    def moved(self, other: SlotMap) -> list[int]:
        return [i for i, (a, b) in enumerate(zip(self.shard, other.shard, strict=True)) if a != b]


def slot_of(key: Column, n_slots: int = N_SLOTS) -> Column:
    """The virtual slot of a key; never changes."""
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def balanced(load: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """First version of a map: largest slot first, each to the shard with the fewest bytes."""
    heap = [(0, s) for s in range(n_shards)]
    shard = [0] * n_slots
    for slot in sorted(range(n_slots), key=lambda i: (-load.get(i, 0), i)):
        bytes_, s = heapq.heappop(heap)
        shard[slot] = s
        heapq.heappush(heap, (bytes_ + load.get(slot, 0), s))
    return SlotMap(1, n_shards, tuple(shard))


def rebalance(old: SlotMap, load: dict[int, int], tolerance: float = 0.01) -> SlotMap:
    """Edit a map until no move from the fullest to the emptiest shard helps: few slots move."""
    shard = list(old.shard)
    total = [0] * old.n_shards
    own: list[set[int]] = [set() for _ in range(old.n_shards)]
    for slot, s in enumerate(shard):
        total[s] += load.get(slot, 0)
        own[s].add(slot)
    goal = tolerance * sum(total) / old.n_shards
    for _ in range(len(shard)):
        high, low = max(range(old.n_shards), key=lambda s: (total[s], -s)), min(range(old.n_shards), key=lambda s: (total[s], s))
        gap = total[high] - total[low]
        fits = [(load.get(i, 0), -i) for i in own[high] if 0 < load.get(i, 0) < gap]
        if gap <= goal or not fits:
            break
        best = -min(fits, key=lambda x: (abs(gap - 2 * x[0]), x[1]))[1]
        shard[best] = low
        own[high].remove(best)
        own[low].add(best)
        total[high] -= load.get(best, 0)
        total[low] += load.get(best, 0)
    return SlotMap(old.version + 1, old.n_shards, tuple(shard))


def grow(old: SlotMap, load: dict[int, int]) -> SlotMap:
    """Add one shard; slots move into it alone, from the fullest shards, until it holds its part."""
    n = old.n_shards + 1
    shard = list(old.shard)
    total = [0] * n
    for slot, s in enumerate(shard):
        total[s] += load.get(slot, 0)
    part = sum(total) / n
    for slot in sorted(range(len(shard)), key=lambda i: (-load.get(i, 0), i)):
        size = load.get(slot, 0)
        if size and total[shard[slot]] - size / 2 >= part and total[n - 1] + size / 2 <= part:
            total[shard[slot]] -= size
            total[n - 1] += size
            shard[slot] = n - 1
    return SlotMap(old.version + 1, n, tuple(shard))


def save_map(spark: SparkSession, slots: SlotMap, path: str) -> None:
    rows = [(slots.version, slots.n_shards, i, s) for i, s in enumerate(slots.shard)]
    spark.createDataFrame(rows, "version int, n_shards int, virtual_slot int, shard int").coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The newest version, or the one asked for. A table of versions times ``n_slots`` small rows."""
    table = spark.read.schema("version int, n_shards int, virtual_slot int, shard int").parquet(path)
    version = version or table.agg(F.max("version")).first()[0]
    rows = table.filter(F.col("version") == version).orderBy("virtual_slot").collect()
    return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def records(docs: DataFrame, n_slots: int = N_SLOTS, overhead: int = OVERHEAD) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(text)
    return docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), crc.alias("text_crc32")).withColumn(
        "virtual_slot", slot_of(F.coalesce(F.col("doc_id"), F.col("text_crc32")), n_slots)
    )


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, slots: SlotMap | None = None, map_path: str | None = None) -> DataFrame:
    """Place every row: shard, and a gapless place in it (``slot``), under the law of equal bytes.

    Two passes over narrow columns. The first sums bytes and rows per virtual slot (``n_slots``
    rows, whatever the input); the second numbers the rows inside each virtual slot, so that no
    window is wider than one slot and no task gets a whole shard.
    """
    spark = docs.sparkSession
    rows = records(picked(docs, "doc_id", "text"), n_slots)
    seen = {r[0]: (r[1], r[2]) for r in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}
    slots = slots or balanced({k: v[0] for k, v in seen.items()}, n_shards, n_slots)
    path = map_path or new_path(spark, "slot_map")
    save_map(spark, slots, path)
    filled = [0] * slots.n_shards
    placed = []
    for i, s in enumerate(slots.shard):
        placed.append((i, s, filled[s]))
        filled[s] += seen.get(i, (0, 0))[1]
    table = spark.createDataFrame(placed, "virtual_slot int, shard int, before long")
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(table), "virtual_slot")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot", F.lit(slots.version).alias("map_version"),
        )
    )
