"""Variable-capacity best-fit packing of token sequences into several permitted sequence lengths.

Pieces go, longest first, into the fullest open bin that still takes them.  Where none does, a
bin of the size that costs least per token it can be expected to carry is opened; the cost
of a sequence has a fixed, a linear and a quadratic part, so neither the shortest nor the longest
permitted length always wins.  At the end every bin is downsized to the smallest permitted length
that holds its contents.  Documents longer than the longest length are cut into pieces.

The corpus is packed in parts of about ``PER_PART`` pieces, each on its own, sorted by Spark; a task holds
one part's placements (never more than ``2 * PER_PART``, however the rows fall).

A document's length is its white-space words plus one end mark, so null and empty texts take one token.  These are not the
tokens of a tokenizer: a text without spaces takes two, however long, and is never cut.
Null ids and repeated rows are rows like any other.  An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmart.sources.shared import stage

CAPACITIES = (512, 1024, 2048, 4096)
FIXED_COST = 64
# A sequence of this length costs twice its linear part.
QUADRATIC_LENGTH = 32_768
PER_PART = 50_000
WORD = r"[^\x20\x09-\x0D]+"
COLUMNS = "doc_id string, piece int, start long, length int, bin_id long, bin_offset int, bin_fill int, capacity int"


def cost(capacity: int) -> float:
    return FIXED_COST + capacity + capacity * capacity / QUADRATIC_LENGTH


def pack(lengths: Sequence[int], capacities: Sequence[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin and offset of every piece (falling lengths), then fill and final capacity of every bin."""
    sizes = sorted(capacities)
    costs = [(cost(c), c) for c in sizes]
    remaining = sum(lengths)
    rooms: list[int] = []  # distinct free spaces of open bins, ascending
    having: dict[int, list[int]] = {}  # free space -> bins that have it
    bins, offsets, fills = [], [], []
    for length in lengths:
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            b = having[room].pop()
            if not having[room]:
                del having[room], rooms[at]
        else:
            room = min((c / min(size, remaining), size) for c, size in costs if size >= length)[1]
            b = len(fills)
            fills.append(0)
        bins.append(b)
        offsets.append(fills[b])
        fills[b] += length
        remaining -= length
        if left := room - length:
            if left not in having:
                having[left] = []
                insort(rooms, left)
            having[left].append(b)
    return bins, offsets, fills, [sizes[bisect_left(sizes, f)] for f in fills]


def _pack_parts(capacities: Sequence[int], per_part: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        opened: dict[int, int] = {}

        def packed() -> pd.DataFrame:
            rows = pd.concat(held, ignore_index=True)
            part = int(rows["part"].iloc[0])
            bins, offsets, fills, sizes = pack(rows["length"].tolist(), capacities)
            first = opened.get(part, 0)
            opened.clear()
            opened[part] = first + len(fills)
            b = np.asarray(bins)
            return rows.drop(columns="part").assign(
                bin_id=part * 2**32 + first + b, bin_offset=np.asarray(offsets, "int32"),
                bin_fill=np.asarray(fills, "int32")[b], capacity=np.asarray(sizes, "int32")[b])

        n = 0
        for batch in batches:
            parts = batch["part"].to_numpy()
            for rows in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(parts)) + 1):
                if not len(rows):
                    continue
                if held and (held[0]["part"].iloc[0] != parts[rows[0]] or n >= 2 * per_part):
                    yield packed()
                    held, n = [], 0
                held.append(batch.iloc[rows])
                n += len(rows)
        if held:
            yield packed()

    return run


def pack_documents(
    docs: DataFrame, capacities: Sequence[int] = CAPACITIES, id_column: str = "doc_id", text_column: str = "text",
    per_part: int = PER_PART,
) -> DataFrame:
    """One row per piece: document, place in it, bin, place in the bin, the bin's fill and capacity."""
    longest = max(capacities)
    text = F.coalesce(F.col(text_column), F.lit(""))
    lengths = stage("pack-lengths")(docs.select(
        F.col(id_column).alias("doc_id"), (F.regexp_count(text, F.lit(WORD)) + 1).cast("long").alias("tokens"),
        F.xxhash64(text).alias("tie")))
    pieces = lengths.select(
        "doc_id", "tokens", "tie",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / longest))).alias("piece"),
    ).select(
        "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("start"),
        F.least(F.lit(longest).cast("long"), F.col("tokens") - F.col("piece") * longest).cast("int").alias("length"), "tie")
    n = lengths.agg(F.sum(F.floor((F.col("tokens") - 1) / longest) + 1)).first()[0] or 0
    parts = max(1, -(-n // per_part))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "tie", "piece"), F.lit(parts)))
    ordered = dealt.repartition(parts, "part").sortWithinPartitions("part", F.desc("length"), "doc_id", "piece", "tie")
    # As text, because pandas would turn numbers with nulls among them into floats.
    placed = ordered.select("part", F.col("doc_id").cast("string").alias("doc_id"), "piece", "start", "length").mapInPandas(
        _pack_parts(capacities, per_part), COLUMNS)
    return placed.withColumn("doc_id", F.col("doc_id").cast("long"))
