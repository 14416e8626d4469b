"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together; a group's weight is the sum of its rows' sizes (UTF-8 bytes plus
a fixed overhead). Groups, heaviest first, go to the shard with the least load so far, held in a heap.

Groups of equal weight are interchangeable to the schedule, so it runs over the table of distinct weights with their
counts. That table cannot have more than sqrt(2 * all bytes) rows: k distinct weights add up to k * k / 2 at least. It is
streamed, heaviest first, through one task that holds nothing but the shard loads; a run of equal weights is laid on
the shards by levels, and its last few groups through the heap, which gives the same loads as one heap step per group.
The heavy work (digests, groups, numbers) stays distributed: rows are joined back by weight and by digest, and numbers
come from bucket counts, so neither a hot group nor a hot weight meets in one task. The text itself is never moved.

Defined cases: null texts form one group of rows of the overhead's size, with checksum 0; an empty text is another
group; repeated rows all stay; null ids are numbered like others; an empty table gives an empty result; of further
columns only those named in ``keep`` are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.plans.session import stored

OVERHEAD = 16
BUCKETS = 256
SLOT_BUCKETS = 1024


def lay_run(loads: list[int], weight: int, count: int) -> list[int]:
    """How many of ``count`` groups of one weight each shard gets; changes ``loads``.

    All shards are first filled up to the highest level that surely takes no more groups than there are; heap steps
    place the rest.
    """
    got = [0] * len(loads)
    low, high = min(loads), min(loads) + weight * count
    if count > 2 * len(loads):
        while low < high:  # the highest level at which counting whole groups below it does not exceed the run
            level = (low + high + 1) // 2
            if sum(max(0, (level - x) // weight) for x in loads) <= count - len(loads):
                low = level
            else:
                high = level - 1
        for i, x in enumerate(loads):
            got[i] = max(0, (low - x) // weight)
            loads[i] = x + got[i] * weight
    heap = [(x, i) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count - sum(got)):
        x, i = heap[0]
        heapq.heapreplace(heap, (x + weight, i))
        got[i] += 1
        loads[i] += weight
    return got


def schedule(shards: int):
    """Turns (weight, n_groups), heaviest first, into one row per weight: shards used and the running counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads = [0] * shards
        for batch in batches:
            used, upto = [], []
            for weight, count in zip(batch["weight"].tolist(), batch["n_groups"].tolist()):
                got = lay_run(loads, weight, count)
                ids = [i for i, n in enumerate(got) if n]
                used.append(ids)
                total, ends = 0, []
                for i in ids:
                    total += got[i]
                    ends.append(total)
                upto.append(ends)
            yield pd.DataFrame({"weight": batch["weight"], "shards": used, "upto": upto})

    return run


def shard(docs: DataFrame, shards: int = 40, text: str = "text", keep: tuple[str, ...] = ("doc_id",), overhead: int = OVERHEAD) -> DataFrame:
    """``keep`` columns with size, text_crc32, shard, slot (gapless from 0 in each shard) and the group's weight."""
    t = F.col(text)
    digest = docs.select(
        *keep,
        (F.coalesce(F.octet_length(t), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(t)), F.unhex(F.lit("00"))).alias("_group"),
    )
    digest = stored(digest, "shard-digests")
    groups = (
        digest.groupBy("_group")
        .agg(F.sum("size").alias("weight"))
        .withColumn("_bucket", F.pmod(F.xxhash64("_group"), F.lit(BUCKETS)).cast("int"))
    )
    groups = stored(groups, "shard-groups")
    runs = groups.groupBy("weight").agg(F.count(F.lit(1)).alias("n_groups"))
    plan = (
        runs.repartition(1)
        .sortWithinPartitions(F.desc("weight"))
        .mapInPandas(schedule(shards), "weight long, shards array<int>, upto array<long>")
    )
    per_bucket = groups.groupBy("weight", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("weight").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("weight", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("weight", "_bucket").orderBy("_group")) - 1
    # running counts hold at most one entry per shard
    chosen = F.element_at("shards", (F.size(F.filter("upto", lambda e: e <= F.col("_place"))) + 1).cast("int"))
    placed = (
        groups.withColumn("_row", place)
        .join(offsets, ["weight", "_bucket"])
        .withColumn("_place", F.col("_offset") + F.col("_row"))
        .join(plan, "weight")
        .select("_group", "weight", chosen.alias("shard"))
    )
    rows = digest.join(placed, "_group").withColumn(
        "_bucket", F.pmod(F.xxhash64(*[F.col(c) for c in keep], F.col("_group")), F.lit(SLOT_BUCKETS)).cast("int")
    )
    rows = stored(rows, "shard-rows")
    sizes = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(*keep, "_group")) - 1
    return (
        rows.withColumn("_row", number)
        .join(starts, ["shard", "_bucket"])
        .withColumn("slot", (F.col("_start") + F.col("_row")).cast("long"))
        .select(*keep, "size", "text_crc32", "shard", "slot", "weight")
    )
