"""Time series per entity: change, rolling statistics, velocity, z-score.

The operators of one entity share the partitioning key, so Spark shuffles and sorts
once for all of them.  Feed them de-duplicated rows: one entity then holds one row per
date, which bounds a window partition by the calendar and not by the data volume.  Where
series are long all the same, ``in_periods`` runs the operators per entity and period.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from signalmart import constants as C
from signalmart.operators.rows import first_n


def _trailing(keys: Sequence[str], order: str, n: int, frame: str) -> WindowSpec:
    """The current row and the ``n - 1`` rows, or days, before it."""
    window = Window.partitionBy(*keys)
    if frame == "rows":
        return window.orderBy(order).rowsBetween(-(n - 1), 0)
    if frame == "days":
        return window.orderBy(F.unix_date(F.col(order).cast("date"))).rangeBetween(-(n - 1), 0)
    raise ValueError(f"frame must be 'rows' or 'days', not {frame!r}")


def relative_change(now, base, scale: int):
    """Change against ``base`` in percent, 0.0 when there is no positive base."""
    return F.when(base > 0, F.round((now - base) / base * 100, scale)).otherwise(0.0)


def pct_change(
    df: DataFrame, value: str, keys: Sequence[str], order: str, out: str, scale: int = 2, lag: int = 1
) -> DataFrame:
    """Percent change against the row ``lag`` places earlier."""
    before = F.lag(value, lag).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_before", before).withColumn(
        out, relative_change(F.col(value), F.col("_before"), scale)
    ).drop("_before")


def rolling_avg(
    df: DataFrame, value: str, keys: Sequence[str], order: str, out: str,
    n: int = C.ROLLING_ROWS, scale: int = 2, frame: str = "rows",
) -> DataFrame:
    return df.withColumn(out, F.round(F.avg(value).over(_trailing(keys, order, n, frame)), scale))


def rolling_stddev(
    df: DataFrame, value: str, keys: Sequence[str], order: str, out: str,
    n: int = C.ROLLING_ROWS, scale: int = 4, frame: str = "rows",
) -> DataFrame:
    """Sample standard deviation; null for a frame of one row."""
    return df.withColumn(out, F.round(F.stddev(value).over(_trailing(keys, order, n, frame)), scale))


def velocity(
    df: DataFrame, value: str, keys: Sequence[str], order: str, out: str, average: str = "rolling_7d_avg",
    n: int = C.ROLLING_ROWS, scale: int = 2, frame: str = "rows",
) -> DataFrame:
    """Percent distance of a value from its own (rounded) rolling average, which is kept as ``average``."""
    df = rolling_avg(df, value, keys, order, average, n, scale, frame)
    return df.withColumn(out, relative_change(F.col(value), F.col(average), scale))


def zscore(
    df: DataFrame, value: str, keys: Sequence[str], out: str, scale: int = 4, long_series: bool = False
) -> DataFrame:
    """Distance from the entity's mean in sample standard deviations, 0.0 without spread.

    The window form shares the shuffle of the other series operators.  For
    ``long_series`` mean and deviation are aggregated, with partial results before the
    shuffle, and joined back.
    """
    mean, std = F.avg(value), F.stddev(value)
    if long_series:
        stats = df.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(mean.alias("_mean"), std.alias("_std"))
        df = df.join(stats, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], "left")
    else:
        whole = Window.partitionBy(*keys)
        df = df.withColumns({"_mean": mean.over(whole), "_std": std.over(whole)})
    score = F.when(F.col("_std") > 0, F.round((F.col(value) - F.col("_mean")) / F.col("_std"), scale)).otherwise(0.0)
    return df.withColumn(out, score).drop("_mean", "_std", *[f"_of_{k}" for k in keys])


def with_lead_rows(df: DataFrame, keys: Sequence[str], order: str, period: Column, n: int) -> DataFrame:
    """Every row with its ``_period``, and the ``n`` rows before each period once more as ``_lead`` rows.

    ``period`` must not decrease along ``order``, which must be unique per entity.  The rows
    to repeat are found among the last ``n`` of every period, so nothing but those few
    is ever brought together per entity.
    """
    placed = df.withColumn("_period", period)
    tails = first_n(placed, [*keys, "_period"], [F.desc(order)], n)
    tails = tails.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    ends = tails.groupBy(*keys, "_period").agg(F.max("_place").alias("_end"))
    ends = ends.withColumn("_next", F.lead(F.struct("_period")).over(Window.partitionBy(*keys).orderBy("_period"))).where(F.col("_next").isNotNull())
    wanted = ends.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys],
        F.col("_next")["_period"].alias("_into"),
        F.explode(F.sequence(F.greatest(F.lit(1), F.col("_end") - n + 1), F.col("_end"))).alias("_at"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    repeated = tails.join(wanted, [*same, F.col("_place") == F.col("_at")]).withColumn("_period", F.col("_into"))
    return placed.withColumn("_lead", F.lit(False)).unionByName(
        repeated.withColumn("_lead", F.lit(True)).select(*df.columns, "_period", "_lead")
    )


def in_periods(
    df: DataFrame, keys: Sequence[str], order: str, period: Callable[[Column], Column] | None, n: int,
    signals: Callable[[DataFrame, list[str]], DataFrame],
) -> DataFrame:
    """``signals(rows, keys)`` of whole series, or of series cut into periods when ``period`` is given.

    ``n`` is how many earlier rows the signals of a row depend on.
    """
    if period is None:
        return signals(df, list(keys))
    cut = with_lead_rows(df, keys, order, period(F.col(order)), n)
    return signals(cut, [*keys, "_period"]).where(~F.col("_lead")).drop("_period", "_lead")
