"""Series that go on from the last rows of what was built before.

A tail holds the last ``n`` rows of every series.  With it in front of the new rows, their rolling figures
are those of the whole series, and no earlier day is read again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalmart.operators.rows import last_n


def with_tail(rows: DataFrame, tail: DataFrame | None, keys: Sequence[str], order: str, late: bool = False) -> DataFrame:
    """The new rows behind their tail, which is marked ``_lead``.

    New rows that do not come after their tail were built before and are left out: a correction of earlier rows
    needs a build over the history.  With ``late`` they stay, in their places among the tail's rows.
    """
    fresh = rows.withColumn("_lead", F.lit(False))
    if tail is None:
        return fresh
    both = fresh.unionByName(tail.select(*rows.columns).withColumn("_lead", F.lit(True)))
    if late:
        return both
    end = F.max(F.when(F.col("_lead"), F.col(order))).over(Window.partitionBy(*keys))
    return both.withColumn("_end", end).where(F.col("_lead") | F.col("_end").isNull() | (F.col(order) > F.col("_end"))).drop("_end")


def continued(
    rows: DataFrame, tail: DataFrame | None, keys: Sequence[str], order: str,
    signals: Callable[[DataFrame, list[str]], DataFrame], late: bool = False,
) -> DataFrame:
    """``signals(rows, keys)`` of the new rows, as if all rows before them were there.

    The tail must hold as many rows as a signal looks back.
    """
    return signals(with_tail(rows, tail, keys, order, late), list(keys)).where(~F.col("_lead")).drop("_lead")


def next_tail(
    rows: DataFrame, tail: DataFrame | None, keys: Sequence[str], order: str, n: int, late: bool = False
) -> DataFrame:
    """The last ``n`` rows of every series, new rows included; series without new rows keep their tail."""
    return last_n(with_tail(rows, tail, keys, order, late).drop("_lead"), keys, order, n)
