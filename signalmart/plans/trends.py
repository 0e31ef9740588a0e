"""Silver trends: momentum and anomalies of search interest per brand."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmart import constants as C
from signalmart import schemas
from signalmart.functions import labels
from signalmart.operators.moments import moments, zscore_from
from signalmart.operators.rows import dedupe
from signalmart.operators.series import in_periods, pct_change, zscore
from signalmart.operators.tails import next_tail, with_tail

SCORE_KEYS = ["brand_name", "date"]
SCORE_COLUMNS = ["brand_type", "category", "trend_score", "geo", "stock_available"]


def drop_incomplete(bronze: DataFrame) -> DataFrame:
    return bronze.dropna(subset=["trend_score", "brand_name"])


def clean(bronze: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Complete scores, one per brand and date: the one loaded first; all columns or those named."""
    return dedupe(drop_incomplete(bronze), SCORE_KEYS, ["ingested_at"], columns, SCORE_COLUMNS)


def momentum(scores: DataFrame, lag: int = 1, keys: Sequence[str] = ("brand_name",)) -> DataFrame:
    """Percent change against the row ``lag`` places earlier."""
    return pct_change(scores, "trend_score", keys, "trend_date", "trend_momentum", lag=lag)


def anomalies(scores: DataFrame, long_series: bool = False, state: DataFrame | None = None) -> DataFrame:
    """Z-score within the brand and whether it is unusual in either direction.

    ``state`` has the moments of every brand's history (``operators.moments``), in place of the rows given.
    """
    if state is not None:
        scored = zscore_from(scores, state, "trend_score", ["brand_name"], "trend_zscore")
    else:
        scored = zscore(scores, "trend_score", ["brand_name"], "trend_zscore", long_series=long_series)
    return scored.withColumn("is_anomaly", labels.is_anomaly(F.col("trend_zscore")))


def _scores(bronze: DataFrame) -> DataFrame:
    return clean(bronze, SCORE_COLUMNS).withColumn("trend_date", F.col("date"))


def tail_of(bronze: DataFrame, tail: DataFrame | None = None, lag: int = 1) -> DataFrame:
    """The scores the next day's momentum looks back to, see ``operators.tails``."""
    return next_tail(_scores(bronze), tail, ["brand_name"], "trend_date", lag)


def moments_of(bronze: DataFrame, tail: DataFrame | None = None) -> DataFrame:
    """The moments of the scores that are new after the ``tail``."""
    fresh = with_tail(_scores(bronze), tail, ["brand_name"], "trend_date").where(~F.col("_lead"))
    return moments(fresh, ["brand_name"], "trend_score")


def trends_silver(
    bronze: DataFrame, as_of: str, *, lag: int = 1, split: Callable[[Column], Column] | None = None,
    tail: DataFrame | None = None, state: DataFrame | None = None,
) -> DataFrame:
    """Silver trends of the given scores; ``split`` cuts long series, for example by ``text.year_of``.

    With a ``tail`` the scores go on from those of earlier days, with a ``state`` they are compared with all of them.
    """
    scores = _scores(bronze)
    if tail is None:
        moving = in_periods(scores, ["brand_name"], "trend_date", split, lag, lambda df, keys: momentum(df, lag, keys))
    else:
        moving = momentum(with_tail(scores, tail, ["brand_name"], "trend_date"), lag).where(~F.col("_lead")).drop("_lead")
    return anomalies(moving, split is not None, state).withColumns({
        "data_source": F.lit(C.TRENDS_SOURCE),
        "ingestion_date": F.lit(as_of),
    }).select(*schemas.TRENDS_SILVER.fieldNames())
