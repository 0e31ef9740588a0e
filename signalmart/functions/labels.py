"""Threshold labels and boolean rules."""

from __future__ import annotations

import operator
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalmart import constants as C

_COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def band(value: Column, bands: Iterable[tuple[str, float, str]], default: str) -> Column:
    """First band that holds; a null value matches none and gets ``default``."""
    rules = [(_COMPARE[compare](value, threshold), name) for compare, threshold, name in bands]
    label = F.when(*rules[0])
    for rule in rules[1:]:
        label = label.when(*rule)
    return label.otherwise(default)


def sentiment_label(score: Column) -> Column:
    return band(score, C.SENTIMENT_BANDS, C.SENTIMENT_DEFAULT)


def coverage_trend(velocity: Column) -> Column:
    return band(velocity, C.COVERAGE_BANDS, C.COVERAGE_DEFAULT)


def price_signal(change_pct: Column) -> Column:
    return band(change_pct, C.PRICE_BANDS, C.PRICE_DEFAULT)


def health_label(index: Column) -> Column:
    return band(index, C.HEALTH_BANDS, C.HEALTH_DEFAULT)


def wow_direction(change: Column) -> Column:
    return band(change, C.WOW_BANDS, C.WOW_DEFAULT)


def holds(condition: Column) -> Column:
    """The condition with unknown taken as false."""
    return F.coalesce(condition, F.lit(False))


def is_anomaly(zscore: Column, limit: float = C.ANOMALY_ZSCORE) -> Column:
    return holds(F.abs(zscore) > limit)


def _alert_rules(sentiment: Column, anomaly: Column, trend: Column) -> list[tuple[Column, str]]:
    """Alert conditions with their reasons, most important first."""
    return [
        (sentiment < C.ALERT_SENTIMENT, C.REASON_SENTIMENT),
        (anomaly, C.REASON_ANOMALY),
        ((trend == "ACCELERATING") & (sentiment < 0), C.REASON_COVERAGE),
    ]


def alert_reason(sentiment: Column, anomaly: Column, trend: Column) -> Column:
    """Reason of the first alert rule that holds, null when none does."""
    return F.coalesce(*[F.when(rule, F.lit(reason)) for rule, reason in _alert_rules(sentiment, anomaly, trend)])


def alert_flag(sentiment: Column, anomaly: Column, trend: Column) -> Column:
    return alert_reason(sentiment, anomaly, trend).isNotNull()
