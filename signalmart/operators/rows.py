"""Picking rows per key: de-duplication, latest row, first n rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], chooser) -> DataFrame:
    """One whole row per key, the smallest or largest by ``order`` and then by the other columns.

    The row travels as one struct through ``min``/``max``.  The aggregation runs
    before the shuffle as well, so a key that holds a large part of the table arrives as
    one row per map task.  Ordering by every column makes the choice deterministic.
    """
    payload = list(dict.fromkeys([*order, *df.columns]))
    ordered = [c for c in payload if c not in keys]
    picked = df.groupBy(*keys).agg(chooser(F.struct(*ordered)).alias("_row"))
    return picked.select(*[c if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def tie_key(columns: Sequence[str]) -> Column:
    """A digest that orders rows by all of ``columns`` alike, whichever of them are read later.

    Every value comes with its length, so different rows are spelled differently.
    """
    def spelled(column: str) -> Column:
        value = F.col(column).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.md5(F.concat(*map(spelled, columns)))


def dedupe(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), columns: Sequence[str] | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Keep the first row of every key; null keys form a group, as in ``dropDuplicates``.

    Rows are moved whole, so Spark cannot prune what is not read later: name the
    ``columns`` that are needed besides keys and order.  ``ties`` decide between rows that the order
    leaves equal; they are read before anything is pruned, so the kept row does not depend on ``columns``.
    """
    if ties:
        df = df.withColumn("_tie", tie_key(ties))
        order = [*order, "_tie"]
    if columns is not None:
        df = df.select(*dict.fromkeys([*keys, *order, *columns]))
    return _pick(df, keys, order, F.min).drop("_tie")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, as_of: Column | str | None = None) -> DataFrame:
    """Keep the newest row of every key, looking no further than ``as_of``."""
    if as_of is not None:
        df = df.where(F.col(order) <= as_of)
    return _pick(df, keys, [order], F.max)


def latest_on_dates(
    df: DataFrame, keys: Sequence[str], order: str, dates: Sequence[str], out: str,
    visible: Callable[[str], Column] | None = None,
) -> DataFrame:
    """For each of several dates the newest row of every key up to that date, in one aggregation.

    One conditional maximum per date, so the table is read and shuffled once however many dates are asked
    for.  ``out`` is the date, ``visible`` a further condition on the rows that a date may see.
    """
    payload = [order, *[c for c in df.columns if c != order and c not in keys]]
    kind = df.schema[order].dataType
    row = F.struct(*payload)

    def seen(date: str) -> Column:
        condition = F.col(order) <= F.lit(date).cast(kind)
        return condition & visible(date) if visible else condition

    wide = df.groupBy(*keys).agg(*[F.max(F.when(seen(d), row)).alias(f"_on_{k}") for k, d in enumerate(dates)])
    picks = [F.struct(F.lit(d).cast("date").alias(out), F.col(f"_on_{k}").alias("_row")) for k, d in enumerate(dates)]
    long = wide.select(*keys, F.explode(F.array(*picks)).alias("_pick")).where(F.col("_pick._row").isNotNull())
    names = [c if c in keys else F.col("_pick._row")[c].alias(c) for c in df.columns]
    return long.select(*names, F.col("_pick")[out].alias(out))


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Keep ``n`` rows per key in the given order.

    Spark applies the limit before the shuffle too (``WindowGroupLimit``), so a hot
    key ships at most ``n`` rows per map task.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def last_n(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """Keep the ``n`` newest rows per key; other columns break ties."""
    others = [F.col(c) for c in df.columns if c != order and c not in keys]
    return first_n(df, keys, [F.desc(order), *others], n)
