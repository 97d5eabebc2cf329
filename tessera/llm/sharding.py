"""Sharding by fixed virtual slots.

Records hash into a few thousand virtual slots. Bytes are summed per slot, and a versioned
slot-to-shard map says which shard holds a slot. Version 0 deals the slots out evenly;
rebalancing edits the map (it moves whole slots) and stores the next version beside it, so
a reader can always tell which records moved and why.

Equal texts share a slot, so a group of copies is in one shard. Only a group that alone has more
bytes than a shard's fair share, which no map could hold with shards of equal size, is spread over
the slots by its records' ids. There are at most as many such groups as shards, whatever the input,
which bounds what is broadcast.

The corpus work is DataFrame expressions only. The driver sees one row per virtual slot.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm._util import stored, work_dir

SLOTS = 4096
#: Rows of a virtual slot are numbered in so many parts, so a large group is no single task.
PARTS = 64


def even_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: neighbouring slots in equal runs."""
    return [i * shards // slots for i in range(slots)]


def rebalance(mapping: list[int], weight: list[int], shards: int, tolerance: float = 0.001) -> list[int]:
    """An edit of ``mapping`` that evens out the summed ``weight`` of the shards.

    Again and again the heaviest shard gives the lightest one the slot nearest to half of
    their difference, or swaps a heavier slot for a lighter one, until neither helps.
    """
    out = list(mapping)
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        load[shard] += weight[slot]
        if weight[slot]:
            held[shard].append((weight[slot], slot))
    for h in held:
        h.sort()
    mean = sum(load) / shards

    def nearest(h: list[tuple[int, int]], want: float) -> tuple[int, int] | None:
        i = bisect.bisect_left(h, (want, -1))
        near = h[max(0, i - 1) : i + 1]
        return min(near, key=lambda x: abs(x[0] - want)) if near else None

    def move(item: tuple[int, int], a: int, b: int) -> None:
        held[a].remove(item)
        bisect.insort(held[b], item)
        load[a] -= item[0]
        load[b] += item[0]
        out[item[1]] = b

    for _ in range(20 * len(out)):
        a, b = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[a] - load[b]
        if gap <= tolerance * mean:
            break
        best, gain = None, 0.0
        item = nearest(held[a], gap / 2)
        if item and 0 < item[0] < gap:
            best, gain = (item, None), gap - abs(gap - 2 * item[0])
        for small in held[b][:: max(1, len(held[b]) // 64)]:
            big = nearest(held[a], small[0] + gap / 2)
            if big and 0 < big[0] - small[0] < gap and gap - abs(gap - 2 * (big[0] - small[0])) > gain:
                best, gain = (big, small), gap - abs(gap - 2 * (big[0] - small[0]))
        if not best:
            break
        move(best[0], a, b)
        if best[1]:
            move(best[1], b, a)
    return out


class SlotMaps:
    """Versions of a slot-to-shard map, each a small Parquet table below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, version: int, mapping: list[int], offset: list[int] | None = None) -> None:
        def values(x: list[int], kind: str):
            return F.split(F.lit(",".join(map(str, x))), ",").cast(f"array<{kind}>")[F.col("id").cast("int")]

        (
            self.spark.range(0, len(mapping), 1, 1)
            .select(
                F.col("id").cast("int").alias("virtual_slot"),
                values(mapping, "int").alias("shard"),
                values(offset or [0] * len(mapping), "bigint").alias("offset"),
            )
            .write.mode("errorifexists")
            .parquet(f"{self.path}/version={version}")
        )

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int, offset long").parquet(f"{self.path}/version={version}")


def assign_shards(
    docs: DataFrame,
    shards: int = 16,
    slots: int = SLOTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    map_path: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot, virtual_slot,
    map_version.

    ``size`` is the UTF-8 bytes of the text plus 1 (null text: 1). ``slot`` is the row's
    position in its shard, without gaps from 0. Rows with equal texts share a virtual slot and so a
    shard, unless their bytes exceed a shard's fair share. Null ids hash like any
    other value. An empty table gives an empty result, and the maps are stored all the
    same. Other columns are not read. A shard can exceed its fair share by at most the
    bytes of one virtual slot.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("_text"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    hot = rows.groupBy("_text").agg(F.sum("size").alias("_b")).filter(F.col("_b") > total / shards)
    spread = rows.join(F.broadcast(hot.select("_text", F.lit(True).alias("_hot"))), "_text", "left")
    key = F.when(F.col("_hot"), F.xxhash64("_text", "doc_id")).otherwise(F.xxhash64("_text"))
    spread = spread.select("doc_id", "size", "text_crc32", F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"))

    per_slot = spread.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    weight, count = [0] * slots, [0] * slots
    for r in per_slot:
        weight[r.virtual_slot], count[r.virtual_slot] = r.b, r.n
    maps = SlotMaps(spark, map_path or work_dir(spark, "slot-map"))
    first = even_map(shards, slots)
    edited = rebalance(first, weight, shards)
    for version, mapping in enumerate((first, edited)):
        seen, offset = [0] * shards, []
        for slot, shard in enumerate(mapping):
            offset.append(seen[shard])
            seen[shard] += count[slot]
        maps.save(version, mapping, offset)

    sub = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(PARTS)).cast("int")
    parted = spread.withColumn("_part", sub)
    up_to = F.sum("_n").over(W.partitionBy("virtual_slot").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    before = parted.groupBy("virtual_slot", "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(up_to, F.lit(0)))
    starts = before.join(F.broadcast(maps.load(1)), "virtual_slot").withColumn("_start", F.col("offset") + F.col("_before"))
    place = F.row_number().over(W.partitionBy("virtual_slot", "_part").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        parted.withColumn("_place", place)
        .join(F.broadcast(starts.select("virtual_slot", "_part", "shard", "_start")), ["virtual_slot", "_part"])  # slots x PARTS rows at most
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "shard",
            (F.col("_start") + F.col("_place")).cast("long").alias("slot"),
            "virtual_slot",
            F.lit(1).alias("map_version"),
        )
    )
