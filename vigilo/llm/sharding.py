"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together.  Groups, largest first, go to the least loaded shard through a
heap.  Groups of one size are interchangeable, so the schedule is made from the histogram of group sizes: per size the
heap says how many groups each shard receives, and groups take their place in that size by rank.  The result equals
group-by-group scheduling, yet the driver holds one row per distinct group size (at most sqrt(2 x total bytes) of
them), never one per group.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilo.llm.common import materialize, text_or_empty

#: Rows of the schedule (sizes x shards) up to which it is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 500_000
#: Rows that share one slot block, and groups that share one rank block.
BLOCK_ROWS = 2_000


def schedule(histogram: list[tuple[int, int]], n_shards: int) -> list[tuple[int, list[int]]]:
    """For each (group size, number of groups), largest first: how many groups each shard receives.

    Exactly what a heap of (load, shard) gives when it deals the groups one by one; long runs of equal groups are
    filled to a common level at once instead of popping each.
    """
    loads = [0] * n_shards
    out = []
    for size, count in sorted(histogram, reverse=True):
        given = [0] * n_shards
        left = count
        if size > 0 and count > 4 * n_shards:
            # The highest level to which every lower shard can be filled with whole groups without using more than there are.
            lo, hi = min(loads), max(loads) + size * count
            while lo < hi:
                level = (lo + hi + 1) // 2
                if sum(max(0, level - x) // size for x in loads) <= count - n_shards:
                    lo = level
                else:
                    hi = level - 1
            for k, x in enumerate(loads):
                given[k] = max(0, lo - x) // size
            left -= sum(given)
        heap = [(loads[k] + given[k] * size, k) for k in range(n_shards)]
        heapq.heapify(heap)
        for _ in range(left):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            given[k] += 1
        for k in range(n_shards):
            loads[k] += given[k] * size
        out.append((size, given))
    return out


def lpt_shards(docs: DataFrame, n_shards: int = 16, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each row of ``docs`` with size, text_crc32, shard, slot.

    Null texts count as empty (size 1).  Repeated rows keep one output row each and share a shard.  An empty table
    gives an empty result.  Other columns of the input are ignored, whatever their names.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    value = text_or_empty(text)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(value) + 1).cast("long").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(value.cast("binary"))).alias("digest"),
    )
    groups = materialize(
        base.groupBy("digest", "size").agg(F.count("*").alias("n")).select("digest", "size", (F.col("size") * F.col("n")).alias("group_size")),
        "lpt-groups",
    )
    histogram = [(r[0], r[1]) for r in groups.groupBy("group_size").count().toLocalIterator()]
    plan = schedule(histogram, n_shards)
    rows = []
    for size, given in plan:
        first = 0
        for k, n in enumerate(given):
            if n:
                rows.append((size, k, first, first + n))
                first += n
    spark = docs.sparkSession
    ranges = spark.createDataFrame(rows, "group_size long, shard int, lo long, hi long")
    if len(rows) <= BROADCAST_ROWS:
        ranges = F.broadcast(ranges)

    # Rank of a group among those of its size: blocks are ranked on their own and shifted by the blocks before them.
    blocks = max(1, -(-max((c for _, c in histogram), default=1) // BLOCK_ROWS))
    parts = groups.withColumn("b", F.pmod(F.xxhash64("digest"), F.lit(blocks)))
    counts = parts.groupBy("group_size", "b").agg(F.count("*").alias("c"))
    before = Window.partitionBy("group_size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("group_size", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("o"))
    ranked = (
        parts.withColumn("r", F.row_number().over(Window.partitionBy("group_size", "b").orderBy("digest")))
        .join(offsets, ["group_size", "b"])
        .withColumn("rank", F.col("o") + F.col("r") - 1)
    )
    placed = ranked.join(ranges, "group_size").where("rank >= lo and rank < hi").select("digest", "size", "shard")

    assigned = materialize(base.join(placed, ["digest", "size"]).select("doc_id", "size", "text_crc32", "shard"), "lpt-rows")
    n_blocks = max(64, assigned.count() // BLOCK_ROWS)
    rows_in = assigned.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)))
    row_counts = rows_in.groupBy("shard", "b").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = row_counts.select("shard", "b", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("o"))
    return (
        rows_in.withColumn("r", F.row_number().over(Window.partitionBy("shard", "b").orderBy("doc_id", "text_crc32")))
        .join(starts, ["shard", "b"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("o") + F.col("r") - 1).cast("long").alias("slot"))
    )
