"""Count, mean and sum of squared deviations as a state that is merged instead of computed again.

A state has one row per key and part (a day, a month); states of parts give the state of the whole, so a history
is summed up without its rows.  Merging follows Chan, Golub and LeVeque, which stays exact where mean and deviation differ a lot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmart.operators.sizing import broadcast_if_small

STATE = ("n", "mean", "m2")


def moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The state of every key; nulls do not count."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def _merge(a: Column, b: Column) -> Column:
    n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
    merged = F.struct(
        n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"),
        (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2"))
    return F.when(a["n"] == 0, F.struct(*[b[c].alias(c) for c in STATE])).when(b["n"] == 0, a).otherwise(merged)


def merged(states: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """One state per key from those of its parts, in the order of ``part``.

    What is brought together per key is one small row per part.
    """
    parts = F.sort_array(F.collect_list(F.struct(part, *STATE)))
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    whole = states.groupBy(*keys).agg(F.aggregate(parts, none, _merge).alias("_state"))
    return whole.select(*keys, *[F.col("_state")[c].alias(c) for c in STATE])


def zscore_from(df: DataFrame, state: DataFrame, value: str, keys: Sequence[str], out: str, scale: int = 4) -> DataFrame:
    """Distance from the mean of the state in sample standard deviations, 0.0 without spread or state."""
    deviation = F.sqrt(F.col("m2") / F.nullif(F.col("n") - 1, F.lit(0)))
    known = state.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("mean").alias("_mean"), deviation.alias("_std"))
    joined = df.join(broadcast_if_small(known), [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], "left")
    score = F.when(F.col("_std") > 0, F.round((F.col(value) - F.col("_mean")) / F.col("_std"), scale)).otherwise(0.0)
    return joined.withColumn(out, score).drop("_mean", "_std", *[f"_of_{k}" for k in keys])
