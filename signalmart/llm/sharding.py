"""Sharding by longest-processing-time scheduling: equal texts stay together, shards get near equal bytes.

A group is all rows with one text.  Groups in order of size go to the least loaded shard,
which a heap yields.  One heap cannot take every group of a large corpus, so small
groups are first bundled: each part of at most ``PER_HEAP`` groups is scheduled to as many
bins as there are shards, and its bins are the groups of the next level.  Groups of more
than a thousandth of a shard are never bundled; there are at most ``1000 * shards``.

Null text: a text of its own, without bytes.  Null ids and repeated rows are rows
like any other.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmart.sources.shared import stage

PER_HEAP = 20_000
ROWS_PER_CELL = 50_000
ROW_BYTES = 8


def _schedule(bins: int):
    """Largest first to the least loaded bin, per part; rows come sorted by part and falling size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, heap = None, []
        for batch in batches:
            chosen = []
            for part, size in zip(batch["part"].tolist(), batch["bytes"].tolist()):
                if part != current:
                    current, heap = part, [(0, b) for b in range(bins)]
                load, b = heap[0]
                heapq.heapreplace(heap, (load + size, b))
                chosen.append(b)
            yield batch[["item", "part", "bytes"]].assign(bin=pd.Series(chosen, dtype="int32", index=batch.index))

    return run


def _in_bins(items: DataFrame, parts: int, bins: int) -> DataFrame:
    """``item, bytes`` scheduled to the bins of their part."""
    dealt = items.select("item", F.pmod(F.xxhash64("item"), F.lit(parts)).alias("part"), "bytes")
    ordered = dealt.repartition(parts, "part").sortWithinPartitions("part", F.desc("bytes"), "item")
    return ordered.mapInPandas(_schedule(bins), "item string, part long, bytes long, bin int")


def schedule(items: DataFrame, shards: int, per_heap: int = PER_HEAP) -> tuple[DataFrame, DataFrame]:
    """Shards of ``item, bytes``: the large items, of which there are at most ``1000 * shards``, and the others."""
    write = stage("shards")
    n, total = items.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    floor = total / (1000 * shards)
    large = items.where(F.col("bytes") >= floor)
    level, levels = items.where(F.col("bytes") < floor), []
    while n > per_heap and n > shards * -(-n // per_heap):
        placed = write(_in_bins(level, -(-n // per_heap), shards))
        bundle = F.concat_ws("-", F.lit(f"bundle{len(levels)}"), "part", "bin")
        levels.append(placed.select("item", bundle.alias("bundle")))
        level = write(placed.groupBy(bundle.alias("item")).agg(F.sum("bytes").alias("bytes")))
        n = level.count()
    top = large.select("item", "bytes", F.lit(True).alias("large")).unionByName(
        level.select("item", "bytes", F.lit(False).alias("large")))
    last = write(_in_bins(top, 1, shards).select("item", F.col("bin").alias("shard")).join(
        top.select("item", "large"), "item"))
    small = last.where("not large").select("item", "shard")
    for members in reversed(levels):
        small = members.join(small.withColumnRenamed("item", "bundle"), "bundle").select("item", "shard")
    return last.where("large").select("item", "shard"), small


def with_slots(placed: DataFrame, order: list[Column], shards: int, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """A gapless ``slot`` from 0 within each ``shard``: numbered per cell of a shard, plus the rows of earlier cells."""
    cells = max(1, -(-placed.count() // (shards * rows_per_cell)))
    spread = placed.withColumn("cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("shard", "cell").agg(F.count("*").alias("n")).select(
        "shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = spread.withColumn(
        "place", F.row_number().over(Window.partitionBy("shard", "cell").orderBy(*order)))
    return numbered.join(offsets, ["shard", "cell"]).withColumn(
        "slot", (F.col("offset") + F.col("place") - 1).cast("long")).drop("cell", "place", "offset")


def shard_documents(
    docs: DataFrame, shards: int = 24, id_column: str = "doc_id", text_column: str = "text", per_heap: int = PER_HEAP,
) -> DataFrame:
    """Every row with its ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` (null)."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = stage("shard-rows")(docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(F.col(text_column), 256), F.lit("null")).alias("item"),
    ))
    groups = stage("shard-groups")(rows.groupBy("item").agg(F.sum("size").alias("bytes")))
    large, small = schedule(groups, shards, per_heap)
    # At most 1000 large groups a shard: these are the ones that may hold many rows, and need no shuffle.
    known = rows.join(F.broadcast(large), "item", "left")
    placed = known.where("shard is not null").unionByName(
        known.where("shard is null").drop("shard").join(small, "item").select(*known.columns))
    placed = stage("shard-placed")(placed)
    numbered = with_slots(placed, [F.col("doc_id"), F.col("text_crc32"), F.col("item")], shards)
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
