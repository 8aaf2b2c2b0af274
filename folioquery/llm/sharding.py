"""Sharding by fixed virtual slots.

A record's hash names one of SLOTS virtual slots, for good. A versioned map gives every
slot a shard. The map is fitted to the bytes counted per slot, and rebalancing edits the
map: only the slots it moves change their shard. The map has SLOTS rows whatever the
corpus holds, so it may be gathered and broadcast.

Law of the map: ``bytes``. Slots go, largest first, to the shard that holds least.

Defined results: a null text has size 1 and the checksum of the empty text; repeated rows
share a slot; a null id is hashed like any value; extra columns are carried along; with an
empty table every slot weighs nothing and is dealt in turn.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Shard of every virtual slot; every edit gives a new version."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def table(self, spark: SparkSession) -> DataFrame:
        """version, shards, virtual_slot, shard: the stored form."""
        return spark.createDataFrame(
            [(self.version, self.shards, i, s) for i, s in enumerate(self.shard_of)],
            "version int, shards int, virtual_slot int, shard int",
        )

    def store(self, spark: SparkSession, path: str) -> None:
        """Write this version beside earlier ones; a stored version is never changed."""
        self.table(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/map_version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, or the latest."""
        rows = spark.read.parquet(path)
        if version is None:
            version = rows.agg(F.max("version")).first()[0]
        got = rows.filter(F.col("version") == version).orderBy("virtual_slot").collect()
        return SlotMap(version, got[0]["shards"], tuple(r["shard"] for r in got))


def virtual_slot(slots: int = SLOTS) -> Column:
    """Virtual slot of a record: a hash of its id and its text."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int")


def size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def slot_bytes(docs: DataFrame, slots: int = SLOTS) -> dict[int, tuple[int, int]]:
    """(bytes, rows) per virtual slot: at most ``slots`` rows reach the driver."""
    got = docs.groupBy(virtual_slot(slots).alias("s")).agg(F.sum(size(F.col("text"))).alias("b"), F.count("*").alias("n"))
    return {r["s"]: (r["b"], r["n"]) for r in got.collect()}


def fit(weights: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
    """A first map: largest slots first, each to the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    shard_of = [0] * slots
    for slot in sorted(range(slots), key=lambda i: (-weights.get(i, 0), i)):
        load, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        # an empty slot counts as one byte, so that empty slots spread too
        heapq.heappush(heap, (load + max(1, weights.get(slot, 0)), shard))
    return SlotMap(1, shards, tuple(shard_of))


def rebalance(old: SlotMap, weights: dict[int, int], shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
    """The next version: slots leave over-full shards for the lightest until all are near the mean.

    More shards may be asked for; they start empty and only receive. Every other slot
    stays where it was.
    """
    shards = shards or old.shards
    if shards < old.shards:
        raise ValueError("shards can only be added")
    shard_of = list(old.shard_of)
    load = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        load[shard] += weights.get(slot, 0)
        held[shard].append(slot)
    mean = sum(load) / shards
    for shard in sorted(range(shards), key=lambda s: -load[s]):
        for slot in sorted(held[shard], key=lambda i: (-weights.get(i, 0), i)):
            weight = weights.get(slot, 0)
            to = min(range(shards), key=lambda s: (load[s], s))
            if load[shard] <= mean * (1 + tolerance):
                break
            if weight and load[to] + weight < load[shard]:
                shard_of[slot] = to
                load[shard] -= weight
                load[to] += weight
    return SlotMap(old.version + 1, shards, tuple(shard_of))


def assign(docs: DataFrame, slot_map: SlotMap) -> DataFrame:
    """The documents with virtual_slot and shard."""
    table = slot_map.table(docs.sparkSession).select("virtual_slot", "shard")
    # SLOTS rows
    return docs.withColumn("virtual_slot", virtual_slot(len(slot_map.shard_of))).join(F.broadcast(table), "virtual_slot")


def place(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in a shard), grown_shard, virtual_slot, map_version.

    Places are numbered inside a virtual slot and shifted by the rows of the shard's
    earlier virtual slots, so no task holds a shard.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    weights = slot_bytes(docs)
    slot_map = fit({s: b for s, (b, _) in weights.items()}, shards)
    before, total = [], [0] * shards
    for slot, shard in enumerate(slot_map.shard_of):
        before.append((slot, shard, total[shard]))
        total[shard] += weights.get(slot, (0, 0))[1]
    table = spark.createDataFrame(before, "virtual_slot int, shard int, before long")
    text = F.coalesce("text", F.lit(""))
    facts = docs.select(
        "doc_id", size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"),
        virtual_slot().alias("virtual_slot"),
    )
    nth = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32"))
    return facts.withColumn("nth", nth).join(F.broadcast(table), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", F.lit(slot_map.version).alias("map_version"),
    )
