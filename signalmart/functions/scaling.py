"""Normalisation of the signals to 0..100 and the weighted index over them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalmart import constants as C


def rescale(value: Column, low: float, high: float) -> Column:
    """Map ``low..high`` linearly to ``0..100``."""
    return (value - low) / (high - low) * 100


def clamp(value: Column, low, high) -> Column:
    """Limit to ``low..high``; null stays null, which ``least``/``greatest`` would not keep."""
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def sentiment_normalized(sentiment: Column) -> Column:
    return F.round(rescale(sentiment, -1, 1), 2)


def trend_normalized(score: Column) -> Column:
    """Integer in, integer out: the score already is 0..100 apart from the clamp."""
    return clamp(score, F.lit(0).cast("bigint"), F.lit(100).cast("bigint"))


def stock_normalized(available: Column, change_pct: Column) -> Column:
    """Null without a share price, the midpoint when only the change is unknown."""
    limit = C.STOCK_CHANGE_LIMIT
    scaled = clamp((change_pct + limit) * (50 / limit), 0.0, 100.0)
    return F.when(available, F.round(F.coalesce(scaled, F.lit(C.STOCK_UNKNOWN)), 2))


def weighted_sum(weights: Mapping[str, float]) -> Column:
    """``sum(weight * column)`` in the order of the mapping; null if any part is null."""
    return reduce(add, [F.col(name) * weight for name, weight in weights.items()])


def composite_index(
    available: Column,
    listed: Mapping[str, float] = C.LISTED_WEIGHTS,
    private: Mapping[str, float] = C.PRIVATE_WEIGHTS,
) -> Column:
    """Index of an entity: which weights apply depends on whether it has a share price."""
    return F.round(F.when(available, weighted_sum(listed)).otherwise(weighted_sum(private)), 2)


def point_change(now: Column, before: Column, scale: int = 2) -> Column:
    return F.round(now - before, scale)
