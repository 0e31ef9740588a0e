"""Share of voice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def share_of_voice(
    counts: DataFrame, entity: Sequence[str], group: Sequence[str], value: str,
    out: str = "share_of_voice_pct", scale: int = 2,
) -> DataFrame:
    """Percent of the group's ``value`` that belongs to the entity, on pre-aggregated counts.

    ``counts`` holds a few rows per entity and group.  Entity totals are a window over
    those rows; group totals are aggregated (with partial sums, so a hot group is no
    problem) and joined back on null-safe keys, so rows without a group keep their share.
    How to join is left to the measured size of the totals.
    """
    mentions = F.sum(value).over(Window.partitionBy(*group, *entity))
    totals = counts.groupBy(*[F.col(g).alias(f"_total_{g}") for g in group]).agg(F.sum(value).alias("_total"))
    same_group = [F.col(g).eqNullSafe(F.col(f"_total_{g}")) for g in group]
    joined = counts.withColumn("_mentions", mentions).join(totals, same_group, "left")
    return joined.withColumn(out, F.round(F.col("_mentions") / F.col("_total") * 100, scale)).drop(
        "_mentions", "_total", *[f"_total_{g}" for g in group]
    )
