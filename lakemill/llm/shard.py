"""Sharding by longest-processing-time scheduling (law `bytes`).

Rows with equal texts form a group and stay together. Groups are sorted by
size and go, largest first, to the least-loaded shard, which a heap yields.

The heap's input is bounded whatever the corpus: a group of at least
1 / (shards * heavy_per_shard) of all bytes is scheduled by itself (there are
at most shards * heavy_per_shard of them, since sizes add up to the total);
all smaller groups are dealt by hash to shards * bundles_per_shard bundles,
which are scheduled like groups. Equal texts have equal hashes, so a bundle
never splits a group. Bundles differ in size by far less than a shard, and the
heap evens out what they differ in.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakemill.llm.common import stage

FIXED_BYTES = 8
#: Rows of one id go to so many blocks of slots.
ROWS_APART = 1024


def schedule(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """(key, size) pairs to key -> shard, largest size first, ties by key."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[key] = s
        heapq.heappush(heap, (load + size, s))
    return out


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", heavy_per_shard: int = 1000, bundles_per_shard: int = 256, rows_per_block: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row.

    Null and empty texts: no bytes, CRC of the empty string, one group. Texts
    of any length count whole. Groups of equal size go in order of their hash,
    to the shard of the smallest number of those that are equally loaded.
    Repeated rows, and rows without an id: each gets its own slot. Empty table:
    no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + FIXED_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("grp"),
    )
    rows = stage(sizes, "sizes")  # the texts are read once
    bundles = shards * bundles_per_shard
    groups = stage(rows.groupBy("grp").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "groups")
    total, count = groups.agg(F.sum("size"), F.sum("n")).first()
    total, count = total or 0, count or 0
    heavy = F.col("size") * (shards * heavy_per_shard) >= total
    bundle = F.pmod("grp", F.lit(bundles)).cast("long")
    alone = groups.where(heavy).select("grp", "size").collect()  # at most shards * heavy_per_shard
    light = groups.where(~heavy).groupBy(bundle.alias("bundle")).agg(F.sum("size").alias("size")).collect()  # at most bundles
    # Bundles get the keys below 0 that no group of their own has.
    named = [((0, r[0]), r[1]) for r in alone] + [((1, r[0]), r[1]) for r in light]
    where = schedule(named, shards)
    of_group = spark.createDataFrame([(k, s) for (kind, k), s in where.items() if kind == 0], "grp long, own_shard int")
    of_bundle = spark.createDataFrame([(k, s) for (kind, k), s in where.items() if kind == 1], "bundle long, bundle_shard int")
    blocks = max(1, -(-count // (shards * rows_per_block)))
    placed = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(of_group), "grp", "left")  # both maps are bounded by parameters, not by the corpus
        .join(F.broadcast(of_bundle), "bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "bundle_shard").alias("shard"), F.pmod(F.xxhash64("doc_id", F.col("row") % ROWS_APART), F.lit(blocks)).cast("long").alias("block"), "row")
    )
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size", "row")) - 1
    return (
        placed.withColumn("inside", inside)
        .join(starts, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
